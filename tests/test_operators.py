"""Operators on hand-made rows, against plain Python."""

import random

from pyspark.sql import functions as F

from tempograph.functions import scoring, temporal, text
from tempograph.operators import graph, mutate, resolve


def links_of(spark, pairs):
    return graph.undirected(spark.createDataFrame(pairs, "subject_id string, object_id string"))


def test_components_match_union_find(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r.node: r.component for r in graph.components(links_of(spark, pairs)).collect()}
    assert got == want


def test_components_of_a_shuffled_path_take_few_rounds(spark, monkeypatch):
    path = list(range(300))
    random.Random(3).shuffle(path)
    links = graph.undirected(spark.createDataFrame(list(zip(path, path[1:], strict=False)), "subject_id long, object_id long"))
    checkpoint, made = graph.kept, []

    def counted(df):
        made.append(checkpoint(df))
        assert len(made) <= 14, "rounds grow with the path"
        return made[-1]

    monkeypatch.setattr(graph, "kept", counted)
    assert {(x.node, x.component) for x in graph.components(links).collect()} == {(i, 0) for i in range(300)}


def test_estimates_do_not_grow_over_rounds_of_joins(spark):
    rows = graph.kept(spark.createDataFrame([(i, (i + 1) % 9) for i in range(9)], "a long, b long"))
    for k in range(5):
        onward = rows.select(F.col("a").alias("k"), F.col("b").alias("c"))
        rows = graph.kept(rows.join(onward, rows.b == onward.k).select("a", F.col("c").alias("b")))
        assert rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**63
        assert {(x.a, x.b) for x in rows.collect()} == {(i, (i + 2 ** (k + 1)) % 9) for i in range(9)}


def test_pagerank_matches_plain_iteration(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rank = {x: 1 / len(near) for x in near}
    for _ in range(20):
        rank = {x: 0.15 / len(near) + 0.85 * sum(rank[y] / len(near[y]) for y in near[x]) for x in near}
    got = {r.node: r.rank for r in graph.pagerank(links_of(spark, pairs)).collect()}
    assert all(abs(got[x] - rank[x]) < 1e-9 for x in rank)


def test_label_propagation_settles_on_groups(spark):
    pairs = [("a1", "a2"), ("a2", "a3"), ("a1", "a3"), ("b1", "b2"), ("b2", "b3"), ("b1", "b3")]
    got = {r.node: r.label for r in graph.label_propagation(links_of(spark, pairs)).collect()}
    assert len({got[x] for x in ("a1", "a2", "a3")}) == 1
    assert len({got[x] for x in ("b1", "b2", "b3")}) == 1
    assert got["a1"] != got["b1"]


def test_maximal_cliques():
    near = {1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}
    assert graph.maximal_cliques([1, 2, 3, 4], near) == [(1, 2, 3), (3, 4)]


def test_survivors_follow_chains(spark):
    m = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "y")], "loser string, keeper string")
    assert {r.loser: r.keeper for r in graph.survivors(m).collect()} == {"d": "a", "c": "a", "b": "a", "x": "y"}


def test_overlap_matches_brute_force(spark):
    r = random.Random(1)
    rows = []
    for i in range(200):
        a, b = r.randrange(20), r.randrange(20)
        rows.append((i, a, a + r.randrange(1, 5) if r.random() < 0.8 else None, b, b + r.randrange(1, 5) if r.random() < 0.8 else None))
    stamp = lambda c: F.timestamp_seconds(F.col(c) * 86_400).cast("timestamp_ntz")
    frame = spark.createDataFrame(rows, "i int, a long, a2 long, b long, b2 long")
    got = {x.i for x in frame.filter(temporal.overlaps(stamp("a"), stamp("a2"), stamp("b"), stamp("b2"))).collect()}
    far = 10**6
    assert got == {i for i, a, a2, b, b2 in rows if a < (b2 or far) and b < (a2 or far)}


def test_merge_and_undo_is_identity(spark):
    facts = spark.createDataFrame(
        [(1, "a", "b", None), (2, "b", "c", None), (3, "c", "d", None), (4, "a", "c", None)], "id long, subject_id string, object_id string, expired_at timestamp_ntz"
    )
    merged = spark.createDataFrame([("b", "a")], "loser string, keeper string")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    after, log = mutate.merge(facts, merged, 1, at)
    rows = {r.id: r for r in after.collect()}
    assert (rows[1].subject_id, rows[1].object_id) == ("a", "a") and rows[1].expired_at is not None
    assert rows[2].subject_id == "a" and rows[3].expired_at is None
    back = mutate.undo(after.select(facts.columns), log, 1)
    assert sorted(back.collect()) == sorted(facts.collect())


def test_name_pairs_match_all_pairs(spark):
    names = [(1, "red small ring"), (2, "Red  small ring"), (3, "small red ring"), (4, "blue cup"), (5, "cup blue"), (6, None), (7, "")]
    got = {(r.a, r.b) for r in resolve.name_pairs(spark.createDataFrame(names, "id long, name string")).collect()}
    assert got == {(1, 2), (1, 3), (4, 5)}


def test_similar_pairs_are_exact(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    got = {(x.a, x.b): x.score for x in resolve.similar_pairs(spark.createDataFrame(rows, "id long, embedding array<double>"), 0.5, blocks=3).collect()}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(cosine(rows[i][1], rows[j][1]), 6) > 0.5}
    assert set(got) == want


def test_rrf_has_no_more_rows_than_keys(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank0 int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, rank0 int")
    got = {r.id: r.score for r in scoring.rrf([(a, 1.0), (b, 1.0)], ["id"], 60).collect()}
    assert set(got) == {1, 2, 3} and max(got, key=got.get) == 2


def test_lexical_rules(spark):
    rows = [
        ("Q1 2023 report", "Q1 2024 report", False), ("Acme Corp", "acme corp", True), ("report may", "report june", False),
        ("the large cup", "large cup", True), ("07 notes here", "7 notes here", True),
    ]
    frame = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert frame.filter(text.lexically_compatible(F.col("a"), F.col("b")) != F.col("want")).count() == 0
    assert spark.range(1).select(text.initialism(F.lit("WHO"), F.lit("World Health Organisation"))).first()[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "subject_id string, object_id string")
    assert graph.components(graph.undirected(none)).count() == 0
    assert resolve.similar_pairs(spark.createDataFrame([], "id long, embedding array<double>"), 0.5).count() == 0


def test_all_overlapping_pairs(spark):
    r = random.Random(6)
    rows = []
    for i in range(80):
        start = r.randrange(200)
        rows.append((f"i{i:02d}", f"s{r.randrange(3)}", start, None if r.random() < 0.1 else start + r.choice([0, 2, 30, 130])))
    at = lambda h: None if h is None else f"2024-02-{1 + h // 24:02d} {h % 24:02d}:00:00" if h < 29 * 24 else None
    facts = spark.createDataFrame([(i, s, at(a), at(z)) for i, s, a, z in rows], "id string, subject_id string, a string, z string")
    facts = facts.select("id", "subject_id", F.col("a").cast("timestamp_ntz").alias("valid_from"), F.col("z").cast("timestamp_ntz").alias("valid_to"))
    far = 10**6
    want = {
        (i, j) for i, s, a, z in rows for j, t, b, y in rows
        if s == t and (a, i) < (b, j) and b < (far if z is None else z) and a < (far if y is None else y)
    }
    for days in (1, 3):
        got = [(x.other.id, x.id) for x in temporal.overlapping_pairs(facts, ["subject_id"], days).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def hard_vectors():
    """Copies, vectors without a length, of other lengths, with a hole, and none."""
    r = random.Random(9)
    rows = [(i, [round(r.gauss(0, 1), 3) for _ in range(4)]) for i in range(50)]
    rows += [(50 + i, list(rows[i][1])) for i in range(30)] + [(80 + i, list(rows[3][1])) for i in range(12)]
    return rows + [(92, [0.0] * 4), (93, None), (94, [1.0, 2.0]), (95, [2.0, 4.0]), (96, [1.0, None, 0.0, 1.0])]


def cosine_of(a, b):
    if a is None or b is None or None in a or None in b or not any(a) or not any(b):
        return None
    dot = sum(x * y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 0.0
    return round(dot / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5, 6)


def best_by_hand(rows, asked, k, over):
    want = {}
    for i in asked:
        near = [(-s, j) for j, v in rows if j != i and (s := cosine_of(dict(rows)[i], v)) is not None and s > over]
        want |= {(i, rank + 1): (j, -s) for rank, (s, j) in enumerate(sorted(near)[:k])}
    return want


def test_all_nearest_match_all_pairs(spark):
    rows = hard_vectors()
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    for k, over, blocks in ((3, 0.2, (2, 3)), (1, -1.0, (1, 1)), (200, -2.0, None)):
        got = {(x.id, x.rank): (x.other_id, abs(x.score) and x.score) for x in resolve.all_nearest(frame.filter("id % 3 = 0"), frame, k, over, blocks=blocks).collect()}
        assert got == best_by_hand(rows, range(0, 97, 3), k, over)


def test_the_best_of_a_block_by_tiles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(resolve, "COLUMNS", 16)
    monkeypatch.setattr(resolve, "ROWS", 8)
    rows = hard_vectors()
    block = resolve.block_of(pa.table({"id": [i for i, v in rows if v], "embedding": [v for _, v in rows if v]}))
    for k, over in ((3, 0.2), (1, -2.0), (40, -2.0)):
        got = {}
        for ids, others, scores in resolve.best_of(block, block, k, over, 6):
            for i, j, s in zip(ids.tolist(), others.tolist(), scores.tolist(), strict=True):
                got[i, sum(x == i for x, _ in got) + 1] = (j, abs(s) and s)
        assert got == best_by_hand(rows, range(97), k, over)


def test_scan_of_queries_without_keys_makes_no_pairs(spark):
    rows = [x for x in hard_vectors() if x[0] < 92]
    frame = spark.createDataFrame(rows, "id long, embedding array<double>")
    found = resolve.nearest(frame, frame.filter("id % 10 = 0"), 5, tables=1, bits=40)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {(x.id, x.rank): (x.other_id, x.score) for x in found.collect()} == best_by_hand(rows, range(0, 92, 10), 5, -2.0)


def test_decisions_over_the_nearest_list_no_pairs(spark, monkeypatch):
    from tempograph.queries import everything

    def refuse(*_, **__):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(resolve, "similar_pairs", refuse)
    for name in ("disambiguated", "redundancy_gate", "blocking_candidates", "merge_components"):
        assert everything()[name][0](spark, "/root/testdata/sf0.01").count()


def test_near_components_match_pairs(spark):
    frame = spark.createDataFrame(hard_vectors(), "id long, embedding array<double>")
    odd = lambda a, b: (a + b) % 4 != 0
    for threshold, allowed in ((0.9, None), (0.7, odd), (0.95, odd)):
        pairs = resolve.similar_pairs(frame, threshold, blocks=3, allowed=allowed)
        listed = pairs.select(F.col("a").alias("subject_id"), F.col("b").alias("object_id"))
        want = {tuple(x) for x in graph.components(graph.undirected(listed)).collect()}
        got = resolve.near_components(frame, threshold, blocks=3, allowed=allowed).collect()
        assert {tuple(x) for x in got} == want and len(got) == len(want)
        known = resolve.cliques(pairs.select("a", "b", F.lit(1).cast("long").alias("weight")), 12)
        inside = resolve.near_groups(frame, threshold, 12, allowed).withColumn("weight", F.lit(1).cast("long"))
        every = lambda rows: sorted((x.component, tuple(x.members), x.weight) for x in rows.collect())
        assert every(resolve.cliques_inside(inside)) == every(known)


def test_blocks_of_vectors_are_copied_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    made = np.random.default_rng(5).standard_normal((20_000, 64))
    column = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), 64).cast(pa.list_(pa.float64()))
    rows = pa.table({"id": pa.array(range(20_000, 0, -1)), "embedding": column})
    tracemalloc.start()
    try:
        block = resolve.block_of(rows)
        assert tracemalloc.get_traced_memory()[1] < 2 * made.nbytes
        for _ in resolve.best_of(block, block, 1, -1.0, 6):
            pass
        # of the tiles, a few of 8 MB beside the block
        assert tracemalloc.get_traced_memory()[1] < made.nbytes + 48_000_000
    finally:
        tracemalloc.stop()
    assert np.array_equal(block[1], (made / np.linalg.norm(made, axis=1)[:, None])[::-1])


def test_similar_pairs_leave_their_task_by_tiles(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(resolve, "COLUMNS", 16)
    monkeypatch.setattr(resolve, "ROWS", 16)
    rows = pa.table({"id": pa.array(range(64)), "embedding": pa.array([[1.0, 0.0]] * 64), "own": pa.array([0] * 64, pa.int32())})
    ids, found = resolve.hits(rows, 0, 0, 0.5, 6, None)
    sizes = [len(x) for x, _, _ in found]
    assert sum(sizes) == 64 * 63 // 2 and max(sizes) <= 256


def test_fallback_scans_where_close_copies_share_keys(spark, tmp_path):
    import numpy as np

    from tempograph.queries import everything

    angle = np.random.default_rng(5).uniform(0, 0.2, 300)
    rows = [(100 * i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angle)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(x.id, x.rank): x.other_id for x in everything()["ann_fallback"][0](spark, str(tmp_path)).collect()}
    score = np.round(np.cos(angle[:, None] - angle[None, :]), 6)
    np.fill_diagonal(score, -2)
    assert got == {(100 * i, r + 1): 100 * int(j) for i in range(300) for r, j in enumerate(np.argsort(-score[i], kind="stable")[:5])}
