"""Retrieval: full text, vectors, fusion, boosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import scoring, vector
from tempograph.operators import search
from tempograph.plans import contextualize as plan
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, VECTORS_SQL, episodes, facts, raw, vectors, with_sql

from .scalar import tok

TERMS = ["the", "with", "from"]
RARE = ["the", "zzzabsent"]


def bm25_sql(terms: list[str], source: str = "episodes", where: str = "true", any_term: bool = False) -> list[str]:
    """CTEs that end in ``hits`` (id, score)."""
    tf = ", ".join(f"len(list_filter(t, lambda w: w = '{x}')) AS tf{i}" for i, x in enumerate(terms))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) AS df{i}" for i in range(len(terms)))
    part = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(terms))
    )
    match = (" OR " if any_term else " AND ").join(f"tf{i} > 0" for i in range(len(terms)))
    s = "o" if any_term else ""
    return [
        f"tk{s} AS (SELECT *, {tok('content')} AS t FROM {source} WHERE {where})",
        f"ct{s} AS (SELECT *, len(t)::DOUBLE AS len, {tf} FROM tk{s})",
        f"st{s} AS (SELECT count(*)::DOUBLE AS n, avg(len) AS mean, {df} FROM ct{s})",
        f"hits{s} AS (SELECT ct{s}.*, round({part}, 6) AS score FROM ct{s}, st{s} WHERE {match})",
    ]


def first_vector(spark, sf):
    return raw(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("query_embedding"))


_built: dict[tuple[str, str], search.TextIndex] = {}


def text_index(spark, sf):
    """The index of the episodes, built once by whichever query of the application needs it first."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        _built[key] = search.TextIndex.build(episodes(spark, sf), carried=("group_id",))
    return _built[key]


def bm25_content_and(spark, sf):
    return text_index(spark, sf).search(TERMS).select("id", "score")


def bm25_scan(spark, sf):
    """The same without an index, by one pass over the texts."""
    return search.bm25(episodes(spark, sf), TERMS).select("id", "score")


def bm25_and_or_ladder(spark, sf):
    return text_index(spark, sf).ladder(RARE).select("id", "score")


def bm25_content_head(spark, sf):
    return search.head(text_index(spark, sf).where(F.col("group_id") == "en").search(TERMS), 10).select("id", "score")


def bm25_facts_active(spark, sf):
    rendered = facts(spark, sf).filter("expired_at is null").withColumn("content", F.concat_ws(" ", "predicate", "object_value"))
    return search.bm25(rendered, ["purchase", "3"]).select("id", "score")


def vector_topk(spark, sf):
    return vector.top_k(vectors(spark, sf), first_vector(spark, sf), 10).select("id", "score")


def vector_topk_filtered(spark, sf):
    return vector.top_k(vectors(spark, sf).filter("group_id = 'g1'"), first_vector(spark, sf), 10).select("id", "group_id", "score")


def vector_scores(spark, sf):
    return vector.scored(vectors(spark, sf), first_vector(spark, sf)).select("id", "score")


def hybrid_rrf(spark, sf):
    return search.hybrid(text_index(spark, sf).search(TERMS), vectors(spark, sf), first_vector(spark, sf), 10).select("id", "score")


def rrf_weighted_content(spark, sf):
    return search.hybrid(text_index(spark, sf).search(TERMS), vectors(spark, sf), first_vector(spark, sf), 10, weights=(0.5, 0.5), rrf_k=1).select("id", "score")


def minmax_seed(spark, sf):
    seeds = scoring.min_max(rrf_weighted_content(spark, sf))
    return seeds.select("id", F.round("score", 6).alias("score"))


def multi_namespace_topk(spark, sf):
    return search.per_namespace(text_index(spark, sf).search(["de"]), 5).select("id", "group_id", "score")


def recency_boost(spark, sf):
    now = F.lit("2024-02-05 00:00:00").cast("timestamp_ntz")
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("valid_from").cast("timestamp"))) / 86_400.0
    return facts(spark, sf).groupBy("subject_id").agg(F.round(F.max(scoring.recency(age, 0.2, 0.01)), 6).alias("boost"))


def degree_bonus(spark, sf):
    n = facts(spark, sf).filter("expired_at is null").groupBy("subject_id").agg(F.countDistinct("predicate").alias("degree"))
    return n.select("subject_id", F.round(scoring.saturating(F.col("degree"), 0.05, 10), 6).alias("bonus"))


def contextualize(spark, sf):
    return plan.contextualize(episodes(spark, sf), text_index(spark, sf).search(TERMS), vectors(spark, sf), first_vector(spark, sf))


def rerank_head_tail(spark, sf):
    hits = search.head(text_index(spark, sf).search(TERMS), 20)
    hits = episodes(spark, sf).select("id", "content").join(F.broadcast(hits), "id")  # 20 rows
    return search.rerank(hits, -F.length("content").cast("double"), 5).select("id", "score", "rank")


HEAD = "SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 30"
V30 = "SELECT id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0)), 6) AS score FROM vectors"


def fused(k: int, w: float) -> list[str]:
    return [
        *bm25_sql(TERMS),
        f"a AS ({HEAD})",
        f"v AS ({V30} ORDER BY score DESC, id LIMIT 30)",
        "ra AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM a)",
        "rv AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM v)",
        f"u AS (SELECT id, {w} / ({k} + r + 1) AS p FROM ra UNION ALL SELECT id, {w} / ({k} + r + 1) AS p FROM rv)",
        "fused AS (SELECT id, round(sum(p), 9) AS score FROM u GROUP BY id ORDER BY score DESC, id LIMIT 10)",
    ]


QUERIES = {
    "bm25_content_and": (bm25_content_and, with_sql(EPISODES_SQL, *bm25_sql(TERMS), body="SELECT id, score FROM hits")),
    "bm25_scan": (bm25_scan, with_sql(EPISODES_SQL, *bm25_sql(TERMS), body="SELECT id, score FROM hits")),
    "bm25_and_or_ladder": (bm25_and_or_ladder, with_sql(EPISODES_SQL, *bm25_sql(RARE), *bm25_sql(RARE, any_term=True), body="SELECT id, score FROM hits UNION ALL SELECT id, score FROM hitso WHERE NOT EXISTS (SELECT 1 FROM hits)")),
    "bm25_content_head": (bm25_content_head, with_sql(EPISODES_SQL, *bm25_sql(TERMS, where="group_id = 'en'"), body="SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 10")),
    "bm25_facts_active": (bm25_facts_active, with_sql(FACTS_SQL, "rendered AS (SELECT id, expired_at, concat_ws(' ', predicate, object_value) AS content FROM facts)", *bm25_sql(["purchase", "3"], "rendered", "expired_at IS NULL"), body="SELECT id, score FROM hits")),
    "vector_topk": (vector_topk, with_sql(VECTORS_SQL, body=f"{V30} ORDER BY score DESC, id LIMIT 10")),
    "vector_topk_filtered": (vector_topk_filtered, with_sql(VECTORS_SQL, body=V30.replace("SELECT id,", "SELECT id, group_id,") + " WHERE group_id = 'g1' ORDER BY score DESC, id LIMIT 10")),
    "vector_scores": (vector_scores, with_sql(VECTORS_SQL, body=V30)),
    "hybrid_rrf": (hybrid_rrf, with_sql(EPISODES_SQL, VECTORS_SQL, *fused(60, 1.0), body="SELECT id, score FROM fused")),
    "rrf_weighted_content": (rrf_weighted_content, with_sql(EPISODES_SQL, VECTORS_SQL, *fused(1, 0.5), body="SELECT id, score FROM fused")),
    "minmax_seed": (minmax_seed, with_sql(EPISODES_SQL, VECTORS_SQL, *fused(1, 0.5), "span AS (SELECT min(score) AS lo, max(score) AS hi FROM fused)", body="SELECT id, round(CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END, 6) AS score FROM fused, span")),
    "multi_namespace_topk": (multi_namespace_topk, with_sql(EPISODES_SQL, *bm25_sql(["de"]), "n AS (SELECT id, group_id, score FROM hits QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id) <= 5)", body="SELECT id, group_id, score FROM n ORDER BY score DESC, id LIMIT 5")),
    "recency_boost": (recency_boost, with_sql(FACTS_SQL, body="SELECT subject_id, round(max(0.2 * exp(-0.01 * greatest((epoch_us(TIMESTAMP '2024-02-05 00:00:00') // 1000000 - epoch_us(valid_from) // 1000000) / 86400.0, 0.0))), 6) AS boost FROM facts GROUP BY subject_id")),
    "degree_bonus": (degree_bonus, with_sql(FACTS_SQL, body="SELECT subject_id, round(0.05 * least(count(DISTINCT predicate) / 10.0, 1.0), 6) AS bonus FROM facts WHERE expired_at IS NULL GROUP BY subject_id")),
    "contextualize": (contextualize, with_sql(EPISODES_SQL, VECTORS_SQL, *fused(1, 0.5), "span AS (SELECT min(score) AS lo, max(score) AS hi FROM fused)", "seed AS (SELECT id, CASE WHEN hi = lo THEN 1.0 ELSE (score - lo) / (hi - lo) END AS score FROM fused, span)", "near AS (SELECT DISTINCT s.id AS seed, n.id FROM seed s JOIN episodes e ON e.id = s.id JOIN episodes n ON n.source_id = e.source_id AND n.group_id = e.group_id AND n.id <> s.id QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY n.id) <= 8)", "deg AS (SELECT seed, count(*) AS d FROM near GROUP BY seed)", "boosted AS (SELECT s.id, least(s.score + 0.05 * least(coalesce(d, 0) / 10.0, 1.0), 1.0) AS score FROM seed s LEFT JOIN deg ON deg.seed = s.id)", "spread AS (SELECT id, score FROM boosted UNION ALL SELECT n.id, 0.5 * b.score FROM near n JOIN boosted b ON b.id = n.seed)", body="SELECT id, round(max(score), 6) AS score FROM spread GROUP BY id")),
    "rerank_head_tail": (rerank_head_tail, with_sql(EPISODES_SQL, *bm25_sql(TERMS), "h AS (SELECT id, content, score FROM hits ORDER BY score DESC, id LIMIT 20)", "p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM h)", body="SELECT id, score, CAST(row_number() OVER (ORDER BY CASE WHEN place <= 5 THEN -length(content) END DESC NULLS LAST, place) AS BIGINT) AS rank FROM p")),
}
