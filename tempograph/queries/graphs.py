"""Graph expansion, pairs, components, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.operators import graph
from tempograph.sources.adapters import EDGES_SQL, VECTORS_SQL, edges, raw, vectors, with_sql


def links(spark, sf):
    return graph.undirected(edges(spark, sf).filter("active"))


def seeds(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def ends(rows):
    """Edges as (src, dst), neither doubled nor deduplicated."""
    return rows.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"))


def bfs_1hop(spark, sf):
    return graph.expand(ends(edges(spark, sf).filter("active")), seeds(spark, ["p:7", "s:3"]), 1)


def bfs_2hop_asof(spark, sf):
    live = edges(spark, sf).filter(F.col("active") & (F.col("valid_from") <= F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")))
    return graph.expand(ends(live), seeds(spark, ["p:7"]), 2)


def fanout_cap(spark, sf):
    return graph.expand(ends(edges(spark, sf).filter("active")), seeds(spark, ["p:7", "s:3"]), 2, cap=8)


def reachable_dependents(spark, sf):
    return graph.reachable(typed(spark, sf), seeds(spark, ["g1"])).select("seed", "node")


def typed(spark, sf):
    """Namespaces and their entities, a forest."""
    v = vectors(spark, sf).select(F.col("group_id").alias("subject_id"), F.concat(F.lit("v:"), F.col("id").cast("string")).alias("object_id"))
    return graph.undirected(v)


def neighbour_degree(spark, sf):
    return graph.degree(links(spark, sf))


def cooccurrence_pairs(spark, sf):
    m = edges(spark, sf).select("episode_id", F.col("subject_id").alias("entity_id"))
    return graph.cooccurrence(m)


def shared_neighbours(spark, sf):
    """Suppliers by the parts that both supply."""
    return graph.shared_neighbours(graph.undirected(edges(spark, sf)).filter("src like 's:%'"))


def connected_components(spark, sf):
    return graph.components(typed(spark, sf))


def pagerank_20(spark, sf):
    ranks = graph.pagerank(links(spark, sf))
    return ranks.select("node", F.round("rank", 9).alias("rank"))


def label_propagation(spark, sf):
    return graph.label_propagation(typed(spark, sf))


def keeper_chains(spark, sf):
    """Parts from the fourth on merged into the part of half their number, followed to the end: the second or the third."""
    m = raw(spark, sf, "part").filter("p_partkey > 3").select(F.col("p_partkey").alias("loser"), F.floor(F.col("p_partkey") / 2).alias("keeper"))
    return graph.survivors(m)


LINKS = "l AS (SELECT subject_id AS src, object_id AS dst FROM edges WHERE active UNION SELECT object_id, subject_id FROM edges WHERE active)"


def hops(seeds_: list[str], links_: str, n: int) -> list[str]:
    start = ", ".join(f"('{s}', '{s}', 0)" for s in seeds_)
    out = [links_, f"h0 AS (SELECT * FROM (VALUES {start}) t(seed, node, depth))"]
    for k in range(1, n + 1):
        out.append(f"h{k} AS (SELECT * FROM h{k - 1} UNION ALL SELECT DISTINCT h.seed, l.dst, {k} FROM h{k - 1} h JOIN l ON l.src = h.node WHERE h.depth = {k - 1} AND NOT EXISTS (SELECT 1 FROM h{k - 1} x WHERE x.seed = h.seed AND x.node = l.dst))")
    return out


EARLY = "l AS (SELECT subject_id AS src, object_id AS dst FROM edges WHERE active AND valid_from <= TIMESTAMP '1995-01-01 00:00:00' UNION SELECT object_id, subject_id FROM edges WHERE active AND valid_from <= TIMESTAMP '1995-01-01 00:00:00')"

ITERATED = ", ".join(f"r{k + 1} AS (SELECT l.dst AS node, 0.15::DOUBLE / (SELECT n FROM nn) + 0.85::DOUBLE * sum(r.rank / d.o) AS rank FROM l JOIN r{k} r ON r.node = l.src JOIN d ON d.src = l.src GROUP BY l.dst)" for k in range(20))
PAGERANK_SQL = with_sql(EDGES_SQL, "l AS MATERIALIZED (SELECT src, dst FROM (SELECT subject_id AS src, object_id AS dst FROM edges WHERE active UNION SELECT object_id, subject_id FROM edges WHERE active) WHERE src <> dst)", "d AS MATERIALIZED (SELECT src, count(*) AS o FROM l GROUP BY src)", "nn AS (SELECT count(*) AS n FROM d)", "r0 AS (SELECT src AS node, 1.0::DOUBLE / (SELECT n FROM nn) AS rank FROM d)", ITERATED.replace(" AS (SELECT l.dst", " AS MATERIALIZED (SELECT l.dst"), body="SELECT node, round(rank, 9) AS rank FROM r20")

QUERIES = {
    "bfs_1hop": (bfs_1hop, with_sql(EDGES_SQL, *hops(["p:7", "s:3"], LINKS, 1), body="SELECT seed, node, depth FROM h1")),
    "bfs_2hop_asof": (bfs_2hop_asof, with_sql(EDGES_SQL, *hops(["p:7"], EARLY, 2), body="SELECT seed, node, depth FROM h2")),
    "fanout_cap": (fanout_cap, with_sql(EDGES_SQL, *hops(["p:7", "s:3"], LINKS, 2), body="SELECT seed, node, depth FROM h2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 8")),
    "reachable_dependents": (reachable_dependents, with_sql(VECTORS_SQL, body="SELECT 'g1' AS seed, 'g1' AS node UNION ALL SELECT 'g1', 'v:' || id FROM vectors WHERE group_id = 'g1'")),
    "neighbour_degree": (neighbour_degree, with_sql(EDGES_SQL, LINKS, body="SELECT src AS node, count(DISTINCT dst) AS degree FROM l GROUP BY src")),
    "cooccurrence_pairs": (cooccurrence_pairs, with_sql(EDGES_SQL, "m AS (SELECT DISTINCT episode_id, subject_id AS x FROM edges)", body="SELECT a.x AS a, b.x AS b, count(*) AS weight FROM m a JOIN m b USING (episode_id) WHERE a.x < b.x GROUP BY 1, 2")),
    "shared_neighbours": (shared_neighbours, with_sql(EDGES_SQL, "m AS (SELECT DISTINCT object_id AS x, subject_id AS via FROM edges)", body="SELECT a.x AS a, b.x AS b, count(*) AS shared FROM m a JOIN m b USING (via) WHERE a.x < b.x GROUP BY 1, 2")),
    "connected_components": (connected_components, with_sql(VECTORS_SQL, body="SELECT 'v:' || id AS node, group_id AS component FROM vectors UNION ALL SELECT DISTINCT group_id, group_id FROM vectors")),
    "pagerank_20": (pagerank_20, PAGERANK_SQL),
    "label_propagation": (label_propagation, None),
    "keeper_chains": (keeper_chains, "WITH RECURSIVE r(loser, keeper) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 3 UNION ALL SELECT loser, keeper // 2 FROM r WHERE keeper > 3) SELECT loser, min(keeper) AS keeper FROM r GROUP BY loser"),
}
