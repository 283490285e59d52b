"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each taken as a word of the
perfect (23, 12) Golay code.  Every word decodes to one codeword, and so do
the words one flip away, which gives one to six indices per word; two words
that differ in two bits or fewer share an index, as the word midway between
them decodes alike for both.

With at most four differing bits over three segments, pigeonhole leaves two
cases: some segment is equal and another differs by two bits at most (key: the
equal segment and an index of the other), or all three differ by one or two
bits (key: an index of each).  Rows of equal key meet, their true distance is
verified, and what remains are links; components follow by star contraction.

Only distinct fingerprints are keyed, so a text copied a million times costs
one row here.  Inside one key the links are a spanning forest of the verified
ones, never all pairs; each row is compared until it is reached.

Null texts count as empty; a text without words has fingerprint zero and is
linked like any other.  Repeated rows share a fingerprint.  Null ids never name
a component unless it has no other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, give_back, parallelism, save_bucketed
from .components import star_components
from .suffix_dedup import chunked, pack, unpack

# Fixed value: a generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
SEGMENTS = ((0, 21), (21, 21), (42, 22))
KEYS_PER_ROW = 190


# ---- fingerprints


def shingle_values(text: str, size: int, seed: int = 42) -> list[int]:
    """XXH64 of each word shingle; of the whole sequence where it is shorter; none for no words."""
    words = text.encode("utf-8", "replace").lower().split()
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist(), strict=True)]


# sixteen 4-bit groups, each to four counters of 16 bits in one word
_SPREAD = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    if not len(hashes):
        return out
    # counters hold up to 65535, so longer runs are summed in parts
    parts = np.maximum(1, -(-sizes // 60_000))
    owner = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + nth * 60_000
    full = np.repeat(sizes > 0, parts)
    for group in range(16):
        lanes = _SPREAD[(hashes >> np.uint64(4 * group)) & np.uint64(15)]
        sums = np.add.reduceat(lanes, begin[full])
        for b in range(4):
            ones = np.bincount(owner[full], weights=((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.float64), minlength=len(sizes))
            out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(4 * group + b)
    return out


def fingerprints_of(texts: list[str], size: int = 4) -> np.ndarray:
    values, sizes = [], []
    for text in texts:
        own = shingle_values(text, size)
        sizes.append(len(own))
        values.extend(own)
    return majority(np.array(values, np.uint64), np.array(sizes, np.int64))


def fingerprint(df: DataFrame, size: int = 4, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """id and the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            made = fingerprints_of([t or "" for t in batch.column("text").to_pylist()], size)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], names=["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


# ---- Golay keys


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and the error of least weight for each syndrome."""

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    single = [remainder(1 << b) for b in range(23)]
    low, high = np.zeros(4096, np.int32), np.zeros(2048, np.int32)
    for b in range(12):
        low[np.arange(4096) >> b & 1 == 1] ^= single[b]
    for b in range(11):
        high[np.arange(2048) >> b & 1 == 1] ^= single[12 + b]
    leader = np.zeros(2048, np.int32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                error = 1 << a | 1 << b | 1 << c
                leader[single[a] ^ (single[b] if b > a else 0) ^ (single[c] if c > b else 0)] = error
    return np.stack([low, np.concatenate([high, high])]), leader


_SYNDROME, _LEADER = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within three bits of each 23-bit word."""
    syndrome = _SYNDROME[0][words & 4095] ^ _SYNDROME[1][words >> 12]
    return (words ^ _LEADER[syndrome]) >> 11


def indices(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the distinct indices of each word and of the words one flip of its bits away."""
    balls = np.stack([decode(words)] + [decode(words ^ (1 << b)) for b in range(width)], axis=1)
    balls.sort(axis=1)
    fresh = np.ones(balls.shape, bool)
    fresh[:, 1:] = balls[:, 1:] != balls[:, :-1]
    row, at = np.nonzero(fresh)
    return row, balls[row, at]


def _paired(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """All combinations, row by row, of two (row, key) lists that are sorted by row."""
    each = np.bincount(b[0], minlength=rows)
    first = np.cumsum(each) - each
    times = each[a[0]]
    row = np.repeat(a[0], times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    return row, np.repeat(a[1], times) << np.int64(12) | b[1][first[row] + nth]


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(key: np.ndarray) -> np.ndarray:
    """A bijection that spreads keys over 64 bits."""
    key = key.astype(np.uint64)
    for shift, factor in zip((30, 27), _MIX, strict=True):
        key = (key ^ key >> np.uint64(shift)) * factor
    return key ^ key >> np.uint64(31)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit key): any two fingerprints four bits apart or less share a key."""
    words = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
    near = []
    for word, (_, width) in zip(words, SEGMENTS, strict=True):
        row, index = indices(word, width)
        near.append((row, index.astype(np.int64)))
    rows, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = near[j]
                rows.append(row)
                keys.append(np.int64(3 * i + j) << np.int64(40) | words[i][row] << np.int64(12) | index)
    row, key = _paired(_paired(near[0], near[1], len(fps)), near[2], len(fps))
    rows.append(row)
    keys.append(key | np.int64(15) << np.int64(40))
    return np.concatenate(rows), _mixed(np.concatenate(keys))


# ---- links


def linked_in(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: each one reached leaves the search."""
    found, left, frontier = [], fps, fps[:0]
    while len(left):
        if not len(frontier):
            frontier, left = left[:1], left[1:]
        reached = []
        for at in range(0, len(frontier), 256):
            if not len(left):
                break
            part = frontier[at : at + 256]
            near = np.bitwise_count(part[:, None] ^ left[None, :]) <= most
            hit = near.any(axis=0)
            found.extend(zip(part[near[:, hit].argmax(axis=0)].tolist(), left[hit].tolist(), strict=True))
            reached.append(left[hit])
            left = left[~hit]
        frontier = np.concatenate(reached) if reached else left[:0]
    return found


def linked_by_key(keys: np.ndarray, fps: np.ndarray, most: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Distinct verified links among rows of equal key."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    bounds = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(bounds)
    group = np.repeat(sizes, sizes)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    some = np.flatnonzero((group > 1) & (group <= small))
    k, f = keys[some], fps[some]
    for step in range(1, small):
        near = np.flatnonzero((k[step:] == k[:-step]) & (np.bitwise_count(f[step:] ^ f[:-step]) <= most)) if len(k) > step else []
        if len(near):
            a.append(f[near])
            b.append(f[near + step])
    for g in np.flatnonzero(sizes > small):
        if links := linked_in(np.unique(fps[bounds[g] : bounds[g + 1]]), most):
            pair = np.array(links, np.uint64)
            a.append(pair[:, 0])
            b.append(pair[:, 1])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    fresh &= a != b
    return a[fresh], b[fresh]


def links(distinct: DataFrame, parts: int, most: int = 4) -> DataFrame:
    """(u, v): links among the distinct fingerprints of a column ``fp``, enough of them to connect all that are linked."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 8192):
                fps = whole[at : at + 8192]
                row, key = fuzzy_keys(fps)
                part = (key >> np.uint64(32)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                key, fp = key[order], fps[row[order]]
                ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
                begin = np.concatenate(([0], ends[:-1]))
                used = np.flatnonzero(ends > begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used, pa.int32()),
                        pa.array([key[begin[p] : ends[p]].tobytes() for p in used], pa.binary()),
                        pa.array([fp[begin[p] : ends[p]].tobytes() for p in used], pa.binary()),
                    ],
                    names=["part", "keys", "fps"],
                )

    def meet(table: pa.Table) -> pa.Table:
        joined = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint64) for c in ("keys", "fps")]
        u, v = linked_by_key(*joined, most)
        return pa.table({"u": pa.array(u.view(np.int64)), "v": pa.array(v.view(np.int64))})

    keyed = distinct.select("fp").mapInArrow(spread, "part int, keys binary, fps binary")
    return keyed.groupBy("part").applyInArrow(meet, "u long, v long").distinct()


def near_groups(df: DataFrame, size: int = 4, most: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "simhash")
    docs = scratch.save(fingerprint(df, size, id_col, text_col), "fingerprints")
    distinct = scratch.save(docs.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    # about three million keys to a part
    parts = max(parallelism(spark), -(-distinct.count() * KEYS_PER_ROW // 3_000_000))
    edges = scratch.save(links(distinct, parts, most), "links")
    roots = star_components(edges, scratch)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---- copies alike in their shingles

SMALL = 16
SLACK = 1e-9
BITS = 2048
CELL = 32
HERE = 500_000  # links that the driver contracts: 8 MB


def shingle_set(text: str, size: int) -> np.ndarray:
    return np.unique(np.array(shingle_values(text, size, 1), np.uint64))


def prefix(own: np.ndarray, listed: np.ndarray, weight: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets alike to ``similarity`` have one of them in common.

    ``listed`` holds frequent shingles, sorted, with their weights; any other
    weighs nothing.  The order is the same for all sets, and that is all that
    the result rests on: the list may come from a sample.  No words: one zero.
    """
    if not len(own):
        return np.zeros(1, np.uint64)
    if len(listed):
        at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        own = own[np.lexsort((own, np.where(listed[at] == own, weight[at], 0)))]
    return own[: len(own) - math.ceil(similarity * len(own) - SLACK) + 1]


def may_be_alike(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, similarity: float) -> np.ndarray:
    """False where sets of n and m shingles whose first common one has these places in order cannot be alike."""
    most = np.minimum(n - at, m - to)
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - SLACK) & (most >= similarity / (1 + similarity) * (n + m) - SLACK)


def parity(own: np.ndarray) -> np.ndarray:
    """For each of ``BITS`` cells, whether an odd number of shingles falls into it; two sets differ in as many shingles as cells, or more."""
    odd = np.bincount((own % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def small_pairs(keys: np.ndarray, node: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs of equal key that may be alike; no key has more than ``SMALL`` rows, and rows are sorted by key."""
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero(keys[step:] == keys[:-step])
        at = at[may_be_alike(n[at], place[at], n[at + step], place[at + step], similarity)]
        found.append(np.stack([node[at], node[at + step]], axis=1))
    return np.concatenate(found)


def _reach(n: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by n: the end of the rows whose n is small enough for each one, and the least n that each can be alike to.

    A row i and a later one j may be alike where j lies before the end of i and the least n of j is no more than n of i.
    """
    share = (1 + similarity) / similarity
    end = np.searchsorted(n, (n - place) * share - n + SLACK, side="right")
    return end, (n - place) * share - n + SLACK


def usable(n: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which of one key's rows, sorted by n, may be alike to another one; no pair is made."""
    end, up_to = _reach(n, place, similarity)
    index = np.arange(len(n))
    # a later row: the greatest bound of a range, from tables of the ranges of 1, 2, 4, ... rows
    tables = [up_to]
    while 2 << len(tables) - 1 <= len(n):
        half = 1 << len(tables) - 1
        tables.append(np.maximum(tables[-1][:-half], tables[-1][half:]))
    out = np.zeros(len(n), bool)
    size = end - index - 1
    level = np.frexp(np.maximum(size, 1))[1] - 1
    for k, table in enumerate(tables):
        at = np.flatnonzero((size > 0) & (level == k))
        out[at] = np.maximum(table[at + 1], table[end[at] - (1 << k)]) >= n[at]
    # an earlier row
    before = np.minimum(index, np.searchsorted(n, up_to, side="right"))
    furthest = np.maximum.accumulate(end)
    at = np.flatnonzero(before > 0)
    out[at] |= furthest[before[at] - 1] > at
    return out


def _blocks(n: np.ndarray, place: np.ndarray, similarity: float, most: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one key's rows, sorted by n, that may be alike, a block at a time."""
    end, up_to = _reach(n, place, similarity)
    size = np.maximum(end - np.arange(len(n)) - 1, 0)
    total = np.cumsum(size)
    a = 0
    while a < len(n):
        z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        i = np.repeat(np.arange(a, z), size[a:z])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(size[a:z]) - size[a:z], size[a:z])
        near = up_to[j] >= n[i]
        yield i[near], j[near]
        a = z


def large_pairs(node: np.ndarray, root: np.ndarray, n: np.ndarray, place: np.ndarray, bits: np.ndarray, similarity: float, most: int | None) -> np.ndarray:
    """Pairs of one key's rows, sorted by n, that are not yet connected and may be alike: all, or the ``most`` nearest ones of each row."""
    found = [np.zeros((0, 2), np.int64)]
    for i, j in _blocks(n, place, similarity):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            far = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            near = np.flatnonzero(far <= (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + SLACK)
            a, b, far = a[near], b[near], far[near]
            if most:
                order = np.lexsort((far, a))
                a, b = a[order], b[order]
                first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else a
                nth = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
                a, b = a[nth < most], b[nth < most]
            found.append(np.stack([node[a], node[b]], axis=1))
    return np.concatenate(found)


def celled(pairs: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(cell, u, v): the pairs, in cells of bounded size of which each node needs few.

    A component of the pairs with up to ``CELL`` nodes is one block; those of a
    larger one are dealt into blocks of about as many by hash.  The pairs of a
    block's nodes u are a cell, or, where they are many, several by their v.
    Equal hashes of two cells make them one.
    """
    below = star_components(pairs, scratch, label, HERE)
    roots = below.filter("node <> root").union(below.select("root", "root").distinct())
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    block = F.xxhash64("root", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = scratch.save(pairs.join(roots.join(blocks, "root").select(F.col("node").alias("u"), block.alias("block")), "u"), f"{label}-blocks")
    parts = dealt.groupBy("block").agg(F.ceil(F.count("*") / (8 * CELL)).alias("parts"))
    cell = F.xxhash64("block", F.pmod(F.xxhash64("v"), F.col("parts")))
    return dealt.join(parts, "block").select(cell.alias("cell"), "u", "v")


def similar_groups(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, with all its columns: the one of least id (of equal rows, one).

    Near copies have a Jaccard similarity of their word shingles of
    ``similarity`` or more; groups are what such links connect.  Equal texts
    are one node.  Two texts without words are alike, and like no other.

    Candidates come from two sources, and every pair is verified on the
    shingles themselves.  The SimHash of the shingles by ``links`` brings the
    closest together, whatever the size of their group.  The prefix filter
    misses none: two sets alike to ``similarity`` have one of their rarest
    n - ceil(similarity * n) + 1 shingles in common, at places that leave room
    for the rest.  Shingles of up to ``SMALL`` texts give all pairs at once;
    those whose parities differ more than alike sets can go before any text
    is shuffled.
    Those of more texts give pairs that are not connected by then and whose
    parities differ no more than alike sets can: first a few of each text, then
    all that are left.  So a group of copies never makes all its pairs, and a
    passage that many texts share only those near the bound.

    Texts are packed into chunks bucketed by chunk, so nothing but keys, pairs
    and paired texts is shuffled: those go, packed, once to each cell of their
    pairs (``celled``), not with every pair.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "similar")
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*others)
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"), rest.alias("rest"))
    chunks = save_bucketed(scratch, chunked(source, 2_000_000), "chunks", "chunk")

    def texts_of(batch: pa.RecordBatch, i: int) -> list[str]:
        data = unpack(batch.column("data")[i].as_py())
        ends = np.cumsum(np.frombuffer(batch.column("lengths")[i].as_py(), np.int64)).tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same = [hashlib.md5(t.encode("utf-8", "replace")).digest() for t in texts_of(batch, i)]
                chunk = pa.array([batch.column("chunk")[i].as_py()] * len(same), pa.int64())
                place = pa.array(range(len(same)), pa.int32())
                yield pa.RecordBatch.from_arrays([chunk, place, batch.column("ids")[i].values, pa.array(same, pa.binary())], names=["chunk", "place", "id", "same"])

    named = chunks.select("chunk", "ids", "lengths", "data").mapInArrow(name, "chunk long, place int, id long, same binary")
    rank = F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("id"), "chunk", "place")
    texts = scratch.save(named.groupBy("same").agg(F.min(rank).alias("best")).select("best.*"), "texts")
    needed = ["chunk", "lengths", "data", "places"]
    in_cells = pa.schema([("cell", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("text", pa.binary())])

    def marked(nodes: DataFrame) -> DataFrame:
        return chunks.join(nodes.groupBy("chunk").agg(F.collect_list("place").alias("places")), "chunk")

    def marked_nodes(nodes: DataFrame) -> DataFrame:
        where = nodes.select(F.shiftright("node", 15).alias("chunk"), F.col("node").bitwiseAND(F.lit(2**15 - 1)).cast("int").alias("place"))
        return marked(where).select(*needed)

    def placed(batches: Iterator[pa.RecordBatch], most: int = 512) -> Iterator[tuple[np.ndarray, list[str]]]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = texts_of(batch, i)
                places = batch.column("places")[i].as_py()
                for at in range(0, len(places), most):
                    place = places[at : at + most]
                    yield np.array(place, np.int64) | batch.column("chunk")[i].as_py() << 15, [whole[p] for p in place]
        give_back()

    # ---- shingles that many texts have, from a bounded number of chunks; they order the shingles and decide nothing

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in placed(batches, 4096):
            value, count = np.unique(np.concatenate([shingle_set(t, size) for t in own]), return_counts=True)
            top = np.flatnonzero(count > 2)
            yield pa.RecordBatch.from_arrays([pa.array(value[top].view(np.int64)), pa.array(count[top])], names=["shingle", "n"])

    counted = chunks.select("chunk").agg(F.count("*")).first()[0]
    sample = texts.filter(F.pmod(F.xxhash64("chunk"), F.lit(max(1, counted // 48))) == 0)
    seen = marked(sample).select(*needed).mapInArrow(often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "shingle").limit(100_000).toArrow()
    listed = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(listed)
    listed, weight = listed[order], top.column("n").to_numpy()[order]

    # ---- what one SimHash brings together

    def simhash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, own in placed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fingerprints_of(own, size).view(np.int64))], names=["node", "fp"])

    prints = scratch.save(marked(texts).select(*needed).mapInArrow(simhash, "node long, fp long"), "prints")
    distinct = scratch.save(prints.groupBy("fp").agg(F.min("node").alias("least")), "distinct")
    amount = texts.count()
    close = links(distinct, max(parallelism(spark), -(-distinct.count() * KEYS_PER_ROW // 3_000_000)))
    least = distinct.select(F.col("fp").alias("v"), F.col("least").alias("to"))
    close = close.join(distinct.withColumnRenamed("fp", "u"), "u").join(least, "v").select(F.col("least").alias("u"), F.col("to").alias("v"))
    same = prints.join(distinct, "fp").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))

    # ---- the prefix filter

    parts = max(parallelism(spark), -(-amount * 100 // 500_000))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, own in placed(batches):
            sets = [shingle_set(t, size) for t in own]
            first = [prefix(s, listed, weight, similarity) for s in sets]
            each = np.array([len(f) for f in first])
            keys = np.concatenate(first)
            node, n = np.repeat(nodes, each), np.repeat(np.array([len(s) for s in sets], np.int32), each)
            place = (np.arange(len(keys)) - np.repeat(np.cumsum(each) - each, each)).astype(np.int32)
            part = (_mixed(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            used, begin = np.unique(part[order], return_index=True)
            cuts = [[x.tobytes() for x in np.split(v[order], begin[1:])] for v in (keys, node, n, place)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(c, pa.binary()) for c in cuts)], names=["part", "keys", "nodes", "n", "place"])

    def meet(table: pa.Table) -> pa.Table:
        kinds = (("keys", np.uint64), ("nodes", np.int64), ("n", np.int32), ("place", np.int32))
        columns = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in kinds]
        order = np.lexsort((columns[2], columns[0]))
        keys, node, n, place = (c[order] for c in columns)
        begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(begin, len(keys)))
        group = np.repeat(sizes, sizes)
        some = np.flatnonzero((group > 1) & (group <= SMALL))
        pair = np.sort(small_pairs(keys[some], node[some], n[some], place[some], similarity), axis=1)
        pair = np.unique(pair, axis=0)
        held = [np.zeros(0, np.int64)]
        for g in np.flatnonzero(sizes > SMALL).tolist():
            a, z = int(begin[g]), int(begin[g] + sizes[g])
            held.append(a + np.flatnonzero(usable(n[a:z], place[a:z], similarity)))
        at = np.concatenate(held)
        nothing = np.zeros(len(pair), np.int32)
        give_back()
        return pa.table(
            {
                "large": pa.array(np.repeat([False, True], [len(pair), len(at)])),
                "u": pa.array(np.concatenate([pair[:, 0], keys[at].view(np.int64)])),
                "v": pa.array(np.concatenate([pair[:, 1], node[at]])),
                "n": pa.array(np.concatenate([nothing, n[at]])),
                "place": pa.array(np.concatenate([nothing, place[at]])),
            }
        )

    def parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, own in placed(batches):
            sets = [shingle_set(t, size) for t in own]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.array([parity(x).tobytes() for x in sets], pa.binary())], names=["node", "n", "bits"])

    def within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("bits_u", "bits_v"))
            size_ = batch.column("n_u").to_numpy().astype(np.int64) + batch.column("n_v").to_numpy()
            far = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            near = pa.array(far <= (1 - similarity) / (1 + similarity) * size_ + SLACK)
            yield batch.select(["u", "v"]).filter(near)

    def screened(pairs: DataFrame) -> DataFrame:
        """The pairs whose parities differ no more than alike sets can: a few hundred bytes a text instead of its shingles."""
        asked = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        bits = scratch.save(marked_nodes(asked).mapInArrow(parities, "node long, n int, bits binary"), "parities")
        u, v = bits.toDF("u", "n_u", "bits_u"), bits.toDF("v", "n_v", "bits_v")
        return pairs.join(u, "u").join(v, "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(within_bound, "u long, v long")

    def sent(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole, rows, held = texts_of(batch, i), [], 0
                for asked in batch.column("asked")[i].as_py():
                    text = pack(whole[asked["place"]].encode("utf-8", "replace"))
                    node = batch.column("chunk")[i].as_py() << 15 | asked["place"]
                    for cell in asked["cells"]:
                        rows.append({"cell": cell, "u": node, "v": None, "text": text})
                        held += len(text)
                        if held > most:
                            yield pa.RecordBatch.from_pylist(rows, in_cells)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, in_cells)
        give_back()

    def alike_in(table: pa.Table) -> pa.Table:
        """The pairs of a cell that are alike; shingles are made when a pair asks for them, and held up to a bound."""
        asks = pc.is_null(table.column("text"))
        texts = table.filter(pc.invert(asks))
        packed = dict(zip(texts.column("u").to_pylist(), texts.column("text").to_pylist(), strict=True))
        sets: dict[int, np.ndarray] = {}
        held, out = 0, []
        for u, v in sorted(zip(*(table.filter(asks).column(c).to_pylist() for c in ("u", "v")), strict=True)):
            for node in (u, v):
                if node not in sets:
                    if held > 64_000_000:
                        sets, held = {k: sets[k] for k in (u, v) if k in sets}, 0
                    sets[node] = shingle_set(unpack(packed[node]).decode("utf-8"), size)
                    held += sets[node].nbytes
            shared = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            every = len(sets[u]) + len(sets[v]) - shared
            if shared >= similarity * every or not every:
                out.append((u, v))
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    def verified(pairs: DataFrame, k: int) -> DataFrame:
        """The alike ones; a text goes once, packed, to each cell of its pairs."""
        cells = scratch.save(celled(pairs, scratch, f"asked-{k}"), f"cells-{k}")
        asked = cells.select(F.explode(F.array("u", "v")).alias("node"), "cell").groupBy("node").agg(F.collect_set("cell").alias("cells"))
        where = asked.select(F.shiftright("node", 15).alias("chunk"), F.struct(F.col("node").bitwiseAND(F.lit(2**15 - 1)).cast("int").alias("place"), "cells").alias("asked"))
        holds = chunks.join(where.groupBy("chunk").agg(F.collect_list("asked").alias("asked")), "chunk").select("chunk", "lengths", "data", "asked")
        texts_sent = holds.mapInArrow(sent, "cell long, u long, v long, text binary")
        met = cells.withColumn("text", F.lit(None).cast("binary")).union(texts_sent).groupBy("cell").applyInArrow(alike_in, "u long, v long")
        return scratch.save(met, f"alike-{k}")

    def unconnected(most: int | None):
        def run(table: pa.Table) -> pa.Table:
            keys, node, root, n, place = (table.column(c).to_numpy() for c in ("key", "node", "root", "n", "place"))
            order = np.lexsort((n, keys))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(keys), -1)[order]
            keys, node, root, n, place = (c[order] for c in (keys, node, root, n, place))
            begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            found = [large_pairs(node[a:z], root[a:z], n[a:z], place[a:z], bits[a:z], similarity, most) for a, z in zip(begin[:-1], begin[1:], strict=True)]
            pair = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            return pa.table({"u": pa.array(pair[:, 0]), "v": pa.array(pair[:, 1])})

        return run

    keyed = marked(texts).select(*needed).mapInArrow(spread, "part int, keys binary, nodes binary, n binary, place binary")
    met = scratch.save(keyed.groupBy("part").applyInArrow(meet, "large boolean, u long, v long, n int, place int"), "met")
    large = met.filter("large").select(F.col("u").alias("key"), F.col("v").alias("node"), "n", "place")
    pairs = met.filter("not large").select("u", "v").union(close.union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    tested = scratch.save(pairs.distinct(), "pairs-0")
    alike = verified(scratch.save(screened(tested), "screened"), 0)
    scratch.drop("parities", "screened", "prints")
    roots = star_components(alike, scratch, "stars-0", HERE)
    for k, most in ((1, 4), (2, None)):
        rooted = scratch.save(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), f"rooted-{k}")
        mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("key")
        active = rooted.join(mixed, "key")
        bits = marked_nodes(active.select("node").distinct()).mapInArrow(parities, "node long, n int, bits binary").drop("n")
        dealt = active.join(bits, "node").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
        found = scratch.save(dealt.groupBy("part").applyInArrow(unconnected(most), "u long, v long").distinct(), f"found-{k}")
        pairs = scratch.save(found.join(tested, ["u", "v"], "left_anti"), f"pairs-{k}")
        if not pairs.head(1):
            if most is None or not found.head(1):
                break
            continue
        tested = tested.union(pairs)
        alike = alike.union(verified(pairs, k))
        roots = star_components(alike, scratch, f"stars-{k}", HERE)
    node = F.shiftleft("chunk", 15).bitwiseOR(F.col("place").cast("long"))
    grouped = texts.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = scratch.save(grouped.groupBy("root").agg(F.min(F.struct("id", "chunk", "place")).alias("best")).select("best.chunk", "best.place"), "kept")
    schema = chunks.schema["rest"].dataType.elementType.simpleString()

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = texts_of(batch, i)
                places = sorted(batch.column("places")[i].as_py())
                other = batch.column("rest")[i].values.take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([other, pa.array([whole[p] for p in places], pa.string())], names=["rest", "text"])

    left = marked(kept).select(*needed, "rest").mapInArrow(leave, f"rest {schema}, text string")
    return left.select(*["text" if c == "text" else F.col(f"rest.{c}") for c in docs.columns])
