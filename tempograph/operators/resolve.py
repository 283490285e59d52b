"""Entity resolution: candidate pairs, decision ladders, merges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.config import DEFAULT, Config
from tempograph.functions import text
from tempograph.functions.scoring import noisy_or
from tempograph.functions.vector import cosine
from tempograph.operators.graph import components, kept, maximal_cliques
from tempograph.operators.reversal import covered


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]
ROWS, COLUMNS = 1024, 1024  # a tile of scores has 8 MB


def bytes_of(vectors: DataFrame) -> int:
    return vectors.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0))).first()[0]


def dealt(vectors: DataFrame, blocks: int | None, block_bytes: int) -> DataFrame:
    """(id, embedding, own, low, high): vectors in blocks by hash, each sent to every pair of blocks that has its own."""
    blocks = blocks or max(4, -(-bytes_of(vectors) // block_bytes))
    own = vectors.filter("embedding is not null").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("other")


def block_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids in order, vectors of length one (shorter ones end in zeros) and how many numbers each has; none for vectors without a length."""
    column = rows.column("embedding").combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    wide = int(sizes.max()) if len(sizes) else 0
    if (sizes == wide).all():
        matrix = flat.reshape(len(sizes), wide)
    else:
        matrix = np.zeros((len(sizes), wide))
        matrix[np.arange(wide) < sizes[:, None]] = flat
    ids = rows.column("id").to_numpy()
    norms = np.concatenate([np.zeros(0), *(np.linalg.norm(matrix[at : at + ROWS], axis=1) for at in range(0, len(matrix), ROWS))])
    order = np.argsort(ids, kind="stable")
    order = order[norms[order] > 0]
    unit = matrix[order]  # the one copy
    unit /= norms[order, None]
    return ids[order], unit, sizes[order]


def tiles(left: tuple, right: tuple, digits: int, over: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, scores) of all pairs by tiles; scores are rounded where they may be over a bound.  Vectors of different lengths have 0."""
    (_, x, m), (_, y, n) = left, right
    wide = max(x.shape[1], y.shape[1])
    x, y = (np.pad(z, ((0, 0), (0, wide - z.shape[1]))) if z.shape[1] < wide else z for z in (x, y))
    mixed = len(m) and len(n) and not (m.min() == m.max() == n.min() == n.max())
    for i in range(0, len(x), ROWS):
        for j in range(0, len(y), COLUMNS):
            score = x[i : i + ROWS] @ y[j : j + COLUMNS].T
            if mixed:
                score[m[i : i + ROWS, None] != n[None, j : j + COLUMNS]] = 0.0
            if over <= -1:
                np.round(score, digits, out=score)
            yield i, j, score


def hits(rows: pa.Table, low: int, high: int, threshold: float, digits: int, allowed: Allowed | None) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The ids of two blocks and, tile by tile, (place, place, score) of their pairs above a cosine; a pair inside a block comes from that block alone."""
    left = block_of(rows.filter(pc.equal(rows.column("own"), low)))
    right = left if low == high else block_of(rows.filter(pc.equal(rows.column("own"), high)))
    ids = left[0] if low == high else np.concatenate([left[0], right[0]])

    def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i, j, score in tiles(left, right, digits, threshold):
            if low == high and j + score.shape[1] <= i:
                continue
            # what rounding could bring over the threshold, and then the rounded score
            x, y = np.nonzero(score > threshold - 10.0**-digits)
            s = np.round(score[x, y], digits)
            x, y = x + i, y + j
            keep = (s > threshold) & (left[0][x] != right[0][y])
            if low == high:
                keep &= x < y
            else:
                y = y + len(left[0])
            if allowed:
                keep &= allowed(ids[x], ids[y])
            yield x[keep], y[keep], s[keep]

    return ids, each()


def similar_pairs(vectors: DataFrame, threshold: float, blocks: int | None = None, digits: int = 6, block_bytes: int = 32_000_000, allowed: Allowed | None = None) -> DataFrame:
    """(a, b, score) of all pairs a < b above a cosine, exactly; ``allowed`` says of arrays of ids which pairs count.

    Vectors are dealt into blocks of about ``block_bytes`` by hash; a task
    compares one pair of blocks by matrix products, tile by tile, and gives out
    each tile's pairs before the next one.  Each vector is sent to as many tasks
    as there are blocks, and no pair under the threshold leaves its task.  This
    is exact and so quadratic in compute, and so may its pairs be;
    ``all_nearest`` and ``near_components`` give results of the vectors' number.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, found = hits(rows, key[0].as_py(), key[1].as_py(), threshold, digits, allowed)
        for x, y, s in found:
            for at in range(0, len(x), 1 << 18):
                a, b = ids[x[at : at + (1 << 18)]], ids[y[at : at + (1 << 18)]]
                made = [pa.array(v, rows.schema.field("id").type) for v in (np.where(a < b, a, b), np.where(a < b, b, a))]
                yield pa.RecordBatch.from_arrays([*made, pa.array(s[at : at + (1 << 18)])], names=["a", "b", "score"])

    return dealt(vectors, blocks, block_bytes).groupBy("low", "high").applyInArrow(compare, f"a {kind}, b {kind}, score double")


def near_components(vectors: DataFrame, threshold: float, blocks: int | None = None, digits: int = 6, block_bytes: int = 32_000_000, allowed: Allowed | None = None) -> DataFrame:
    """(node, component) of the vectors in pairs of ``similar_pairs``: the least node each one is connected to.

    A task joins the pairs of its two blocks as it meets them and gives out a
    tree per component, at most one link a vector, instead of the pairs.
    Trees connect what the pairs connect.  A node of a tree has up to 16 below.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        ids, found = hits(rows, key[0].as_py(), key[1].as_py(), threshold, digits, allowed)
        root = np.arange(len(ids))
        for x, y, _ in found:
            joined(root, x, y)
        order = np.lexsort((np.arange(len(ids)), root))
        # members of each component in turn, and their place in it
        first = np.searchsorted(root[order], root[order], side="left")
        place = np.arange(len(order)) - first
        below = np.flatnonzero(place > 0)
        above = first[below] + (place[below] - 1) // 16
        made = [pa.array(ids[order[at]], rows.schema.field("id").type) for at in (below, above)]
        yield pa.RecordBatch.from_arrays(made, names=["src", "dst"])

    links = kept(dealt(vectors, blocks, block_bytes).groupBy("low", "high").applyInArrow(join, f"src {kind}, dst {kind}").distinct())
    return components(links.union(links.select("dst", "src")))


def joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Make the components of each x and y one, in place; every node holds its root, the least node."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            onward = root[root]
            if (onward == root).all():
                break
            root[:] = onward


def best_of(asked: tuple, held: tuple, k: int, over: float, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, others, scores) of the k best of one block for each query of another, some queries at a time."""
    if not len(held[0]):
        return
    for i, j, score in tiles(asked, held, digits, -2.0):
        ids, others = asked[0][i : i + ROWS], held[0][j : j + COLUMNS]
        if j == 0:
            best, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        score[ids[:, None] == others[None, :]] = -np.inf
        # ids ascend, so what only ties with a kept one loses to it
        row = np.flatnonzero((score > best[:, -1:]).any(axis=1))
        part, line = score[row], np.arange(len(row))
        tops, at = np.full((len(row), k), -np.inf), np.zeros((len(row), k), np.int64)
        for r in range(min(k, len(others))):
            at[:, r] = part.argmax(axis=1)
            tops[:, r] = part[line, at[:, r]]
            part[line, at[:, r]] = -np.inf
        both, whom = np.concatenate([best[row], tops], axis=1), np.concatenate([who[row], at + j], axis=1)
        order = np.argsort(-both, axis=1, kind="stable")[:, :k]
        best[row], who[row] = np.take_along_axis(both, order, 1), np.take_along_axis(whom, order, 1)
        if j + len(others) == len(held[0]):
            x, r = np.nonzero(best > over)
            yield ids[x], held[0][who[x, r]], best[x, r]


def all_nearest(queries: DataFrame, vectors: DataFrame, k: int, over: float = -2.0, digits: int = 6, block_bytes: int = 32_000_000, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(id, other_id, score, rank): the k nearest of all vectors to each query, exactly, of those above a cosine; ties to the lesser id.

    Queries and vectors are dealt into blocks; a task compares one block of
    each, tile by tile, and keeps the best k of a query, so that rows grow with
    the queries.  Compute grows with queries times vectors.
    """
    q, v = blocks or (max(1, -(-bytes_of(queries) // block_bytes)), max(8, -(-bytes_of(vectors) // block_bytes)))
    kind = vectors.schema["id"].dataType.simpleString()

    def send(rows: DataFrame, asks: bool, own: int, others: int) -> DataFrame:
        rows = rows.filter("embedding is not null").withColumn("_own", F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"))
        rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        pair = ("_own", "_other") if asks else ("_other", "_own")
        return rows.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(asks).alias("asks"), F.col(pair[0]).alias("q"), F.col(pair[1]).alias("v"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        asked, held = (block_of(rows.filter(mask)) for mask in (rows.column("asks"), pc.invert(rows.column("asks"))))
        id_type = rows.schema.field("id").type
        del rows  # the blocks are copies
        for ids, others, score in best_of(asked, held, k, over, digits):
            made = [pa.array(x, id_type) for x in (ids, others)]
            yield pa.RecordBatch.from_arrays([*made, pa.array(score)], names=["id", "other_id", "score"])
        del asked, held
        pa.default_memory_pool().release_unused()  # the worker lives on beside others

    sent = send(queries, True, q, v).unionByName(send(vectors, False, v, q))
    found = sent.groupBy("q", "v").applyInArrow(search, f"id {kind}, other_id {kind}, score double")
    order = Window.partitionBy("id").orderBy(F.col("score").desc(), "other_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("id", "other_id", "score", "rank")


def lsh_keys(vectors: DataFrame, tables: int = 16, bits: int = 12, seed: int = 3) -> DataFrame:
    """(id, key): random-hyperplane keys, one per table."""
    kind = vectors.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[rows["embedding"].notna()]
            if not len(rows):
                continue
            matrix = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
            planes = np.random.default_rng(seed).standard_normal((matrix.shape[1], tables * bits))
            signs = (matrix @ planes > 0).reshape(len(rows), tables, bits)
            keys = (signs * (1 << np.arange(bits))).sum(2) + (np.arange(tables) << bits)
            yield pd.DataFrame({"id": np.repeat(rows["id"].to_numpy(), tables), "key": keys.ravel()})

    return vectors.select("id", "embedding").mapInPandas(sign, f"id {kind}, key long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 48, bits: int | None = None, digits: int = 6, floor: int = 3) -> DataFrame:
    """(id, other_id, score, rank): the k nearest vectors of each query among those that share a key with it, verified by cosine.

    ``bits`` grow with the number of vectors, so that a key holds a few dozen
    whatever the size; more ``tables`` find more of neighbours that are not
    very near.  A query for which the keys bring fewer than ``floor``
    times k candidates is compared with every vector instead (the fallback).
    """
    if bits is None:
        bits = max(2, int(math.log2(max(vectors.count(), 2) / 96) + 1))
    v = vectors.filter("embedding is not null")
    keys = lsh_keys(v, tables, bits)
    asked = queries.select("id").join(keys, "id").select(F.col("id").alias("q"), "key")
    met = asked.join(keys, "key").filter("q <> id").select("q", F.col("id").alias("other_id")).distinct()
    enough = met.groupBy("q").agg(F.count("*").alias("n")).filter(F.col("n") >= floor * k).select("q")
    few = kept(queries.select("id", "embedding").join(enough, F.col("id") == F.col("q"), "left_anti"))
    pairs = met.join(enough, "q", "left_semi")
    a = queries.select(F.col("id").alias("q"), F.col("embedding").alias("_a"))
    b = v.select(F.col("id").alias("other_id"), F.col("embedding").alias("_b"))
    scored = pairs.join(b, "other_id").join(a, "q").withColumn("score", F.round(cosine(F.col("_a"), F.col("_b")), digits)).filter("score is not null")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "other_id")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("id"), "other_id", "score", "rank").unionByName(all_nearest(few, v, k, digits=digits))


def classify(cosine: Column, lexical: Column, floor_ok: Column, config: Config = DEFAULT) -> Column:
    """Merge, PotentialAlias or New."""
    return (
        F.when((cosine >= config.merge_cosine) & lexical, F.when(floor_ok, "Merge").otherwise("PotentialAlias"))
        .when((cosine >= config.alias_cosine) & lexical, "PotentialAlias")
        .otherwise("New")
    )


def write_gate(temporal_conflict: Column, proposed: Column, is_same: Column, confidence: Column, config: Config = DEFAULT) -> Column:
    """A conflict of dates rejects; a verdict must say the same and be sure; no verdict keeps what was proposed."""
    return (
        F.when(temporal_conflict, "Reject")
        .when(is_same.isNull(), proposed)
        .when(~is_same, "Reject")
        .when(confidence.isNull() | (confidence < config.confidence_floor), F.when(proposed == "Merge", "PotentialAlias").otherwise(proposed))
        .otherwise("Merge")
    )


def alias_outcome(cosine: Column, lexical: Column, config: Config = DEFAULT) -> Column:
    """What becomes of a pending alias: resolved, revoked or kept; null where there is no distance."""
    sure = cosine >= config.merge_cosine
    return F.when(cosine.isNull(), None).when(sure & lexical, "resolved").when(sure | (cosine < config.revoke_cosine), "revoked").otherwise("kept")


def name_pairs(entities: DataFrame, overlap: float = 0.9) -> DataFrame:
    """(a, b) of entities of equal normalised label, or with so much of their words in common.

    Candidates of the second kind share one of their rarest words: a pair with
    Jaccard j of n words shares at least one of the first n - ceil(j n) + 1 by
    any fixed order, here from rare to frequent.
    """
    named = entities.select("id", text.normalize_label(F.col("name")).alias("label"))
    equal = named.groupBy("label").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids")).filter(F.size("ids") > 1)
    equal = equal.select("a", F.explode("ids").alias("b")).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = named.select("label").distinct().withColumn("words", F.array_distinct(text.tokens(F.col("label")))).filter(F.size("words") > 0)
    each = labels.select("label", "words", F.explode("words").alias("word"))
    frequency = each.groupBy("word").agg(F.count("*").alias("n"))
    ordered = each.join(frequency, "word").groupBy("label", "words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ordered"))
    size = F.size("words")
    prefix = F.slice(F.col("ordered"), F.lit(1), size - F.ceil(F.lit(overlap) * size).cast("int") + 1)
    keys = ordered.select("label", "words", F.explode(prefix).alias("_k")).select("label", "words", F.col("_k.word").alias("word"))
    x, y = (keys.select("word", F.col("label").alias(f"{s}_label"), F.col("words").alias(f"{s}_words")) for s in "xy")
    alike = x.join(y, "word").filter("x_label < y_label").filter(text.jaccard(F.col("x_words"), F.col("y_words")) >= overlap)
    alike = alike.select("x_label", "y_label").distinct()
    first = named.groupBy("label").agg(F.min("id").alias("id"))
    p, q = (first.select(F.col("label").alias(f"{s}_label"), F.col("id").alias(s)) for s in "xy")
    far = alike.join(p, "x_label").join(q, "y_label").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return equal.union(far).distinct()


def repoint(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Facts with losers replaced by keepers; those that become loops are marked to expire."""
    s = merged.select(F.col("loser").alias("_s"), F.col("keeper").alias("_sk"))
    o = merged.select(F.col("loser").alias("_o"), F.col("keeper").alias("_ok"))
    out = facts.join(s, facts.subject_id == s._s, "left").join(o, facts.object_id == o._o, "left")
    out = out.withColumn("subject_id", F.coalesce("_sk", "subject_id")).withColumn("object_id", F.coalesce("_ok", "object_id")).drop("_s", "_sk", "_o", "_ok")
    return out.withColumn("loops", F.col("subject_id") == F.col("object_id"))


def merged_confidence(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("confidence", noisy_or(F.col("a_confidence"), F.col("b_confidence")))


def corroboration(frequency: Column) -> Column:
    """Weight of something shared, the rarer the more; none beyond eight."""
    return F.when(frequency <= 8, F.round(F.lit(2.0**20) / (1 + F.log2(frequency)))).otherwise(0.0).cast("long")


def cliques(pairs: DataFrame, most: int = 32) -> DataFrame:
    """(component, members, weight) of the maximal cliques of pairs (a, b, weight), for components of up to ``most`` members.

    Larger components are left out, as a chain of likenesses that long is no
    group; so a task holds no more than ``most`` members and their pairs.
    """
    pairs = kept(pairs)
    of = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(pairs.select("b", "a")))
    return cliques_inside(pairs.join(small(of, most).withColumnRenamed("node", "a"), "a"))


def small(of: DataFrame, most: int) -> DataFrame:
    """The rows (node, component) of components of up to ``most`` members."""
    sized = of.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("component")
    return of.join(sized, "component").select("node", "component")


def near_groups(vectors: DataFrame, threshold: float, most: int = 32, allowed: Allowed | None = None) -> DataFrame:
    """(a, b, score, component): the pairs of ``similar_pairs`` in components of up to ``most`` members, which no more than those are made for."""
    few = kept(small(near_components(vectors, threshold, allowed=allowed), most))
    pairs = similar_pairs(vectors.join(few.select(F.col("node").alias("id")), "id", "left_semi"), threshold, allowed=allowed)
    return pairs.join(few.withColumnRenamed("node", "a"), "a")


def cliques_inside(inside: DataFrame) -> DataFrame:
    """(component, members, weight) of the maximal cliques of pairs (a, b, weight, component) of small components."""
    kind = inside.schema["a"].dataType.simpleString()

    def find(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict = {}
        weight = {}
        for a, b, w in zip(rows["a"], rows["b"], rows["weight"], strict=True):
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
            weight[min(a, b), max(a, b)] = w
        found = maximal_cliques(list(adjacent), adjacent)
        totals = [sum(weight[x, y] for i, x in enumerate(c) for y in c[i + 1 :]) for c in found]
        return pd.DataFrame({"component": [key[0]] * len(found), "members": [list(c) for c in found], "weight": totals})

    return inside.groupBy("component").applyInPandas(find, f"component {kind}, members array<{kind}>, weight long")


def merge_groups(pairs: DataFrame, most: int = 32) -> DataFrame:
    """(component, members): groups to merge, cliques that do not overlap, larger ones first, then heavier; the first member is the keeper."""
    return covered(cliques(pairs, most)).withColumn("members", F.array_sort("members"))
