"""Search arms over entities, facts and episodes, and their fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import gates, scoring, text, vector
from tempograph.operators import resolve, search
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, NAMES_SQL, VECTORS_SQL, episodes, facts, names, raw, vectors, with_sql

from .recall import TERMS, bm25_sql, first_vector, text_index
from .sinks import alias_facts_of


def rendered_names(spark, sf):
    return names(spark, sf).withColumn("content", F.concat_ws(" ", "name", "type_name"))


def bm25_entities(spark, sf):
    """Entities whose name or type has the word asked for, by rank, the best 50."""
    hits = search.bm25(rendered_names(spark, sf), ["small"])
    return search.head(hits, 50).select("id", "score")


def fts_join_entities(spark, sf):
    """Postings joined with their rows, of two namespaces or none."""
    n = rendered_names(spark, sf)
    found = n.select("id", F.explode(F.array_distinct(text.tokens(F.col("content")))).alias("term")).filter(F.col("term").isin("ring", "gear"))
    rows = n.filter(text.in_namespaces(["Brand#2", "Brand#3", "Brand#4"])).select("id", "group_id")
    return found.join(rows, "id").select("id", "term", "group_id")


def fact_vectors(spark, sf):
    return vectors(spark, sf).select("id", "embedding").join(facts(spark, sf).filter("expired_at is null").select("id", "group_id"), "id")


def vector_topk_facts(spark, sf):
    """Facts in force by the vectors of their number."""
    return vector.top_k(fact_vectors(spark, sf), first_vector(spark, sf), 10).select("id", "score")


def vector_topk_episodes(spark, sf):
    """Episodes up to an instant by the vectors of their number."""
    e = episodes(spark, sf).filter("timestamp <= timestamp_ntz'2024-01-15 00:00:00'").select("id")
    return vector.top_k(vectors(spark, sf).select("id", "embedding").join(e, "id"), first_vector(spark, sf), 10).select("id", "score")


def ann_nearest(spark, sf):
    """The ten nearest of every hundredth vector by random-hyperplane keys, with the exact scan where these bring too few."""
    v = vectors(spark, sf)
    return resolve.nearest(v, v.filter("id % 100 = 0"), 10)


def ann_fallback(spark, sf):
    """The same where no number of candidates is enough, as long keys still bring close copies: every query falls back to the scan."""
    v = vectors(spark, sf)
    return resolve.nearest(v, v.filter("id % 100 = 0"), 5, tables=1, bits=40, floor=1 << 40)


def index_fetch_sizes(spark, sf):
    """How many an index must bring for ten of each namespace."""
    v = vectors(spark, sf)
    total = v.agg(F.count("*").alias("total"))
    per = v.groupBy("group_id").agg(F.count("*").alias("within")).crossJoin(F.broadcast(total))
    return per.select("group_id", gates.fetch_size(F.lit(10).cast("bigint"), F.col("total"), F.col("within")).alias("fetch"))


def arm(hits, k=30):
    return scoring.ranked(search.head(hits, k).select("id", "score"), ["id"], [F.col("score").desc(), F.col("id")])


def fact_hits(spark, sf):
    rendered = facts(spark, sf).filter("expired_at is null").withColumn("content", F.concat_ws(" ", "predicate", "object_value"))
    return search.bm25(rendered, ["purchase", "3"])


def rrf_facts(spark, sf):
    near = vector.top_k(fact_vectors(spark, sf), first_vector(spark, sf), 30)
    fused = scoring.rrf([(arm(near), 1.0), (arm(fact_hits(spark, sf)), 1.0)], ["id"], 60)
    return search.head(fused, 10).select("id", "score")


def rrf_content_streams(spark, sf):
    """Text hits of episodes with the vectors of their number, no text left out."""
    e = vectors(spark, sf).select("id", "embedding").join(episodes(spark, sf).select("id"), "id")
    near = vector.top_k(e, first_vector(spark, sf), 30)
    return scoring.rrf([(arm(text_index(spark, sf).search(TERMS)), 1.0), (arm(near), 1.0)], ["id"], 1).select("id", "score")


def prefixed(hits, prefix):
    return hits.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("id"), "rank0")


def rrf_with_facts(spark, sf):
    """Entities fused with facts under names of their own; reserved predicates go first."""
    rendered = alias_facts_of(spark, sf).filter("expired_at is null").filter(~gates.reserved(F.col("predicate"))).withColumn("content", F.concat_ws(" ", "predicate", "object_value"))
    found = arm(search.bm25(rendered, ["view"]))
    near = arm(vector.top_k(vectors(spark, sf), first_vector(spark, sf), 30))
    return scoring.rrf([(prefixed(near, ""), 1.0), (prefixed(found, "fact:"), 1.0)], ["id"], 60).select("id", "score")


def rrf_merge(spark, sf):
    """Two lists of keys fused, the best 15: score first, then key."""
    a = raw(spark, sf, "part").filter("p_partkey <= 20").select(F.col("p_partkey").alias("id"), (-F.col("p_partkey")).cast("double").alias("score"))
    b = raw(spark, sf, "part").filter("p_partkey between 11 and 30").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("double").alias("score"))
    return search.head(scoring.rrf([(arm(a), 1.0), (arm(b), 1.0)], ["id"], 60), 15).select("id", "score")


def raw_recall(spark, sf):
    """The whole pipeline but rendering: both searches, the metadata filter, fusion, and a reranked head."""
    hits = text_index(spark, sf).where(F.col("group_id").isin("en", "de")).search(TERMS)
    near = vector.top_k(vectors(spark, sf), first_vector(spark, sf), 30)
    fused = search.head(scoring.rrf([(arm(hits), 0.5), (arm(near), 0.5)], ["id"], 1), 10)
    return search.rerank(fused, -F.col("id").cast("double"), 3).select("id", "score", "rank")


def top_names_by_access(spark, sf):
    """The 20 users with most events, by name."""
    n = raw(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    named = n.select("user_id", "n", F.coalesce(F.get_json_object(F.to_json(F.struct(F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("name"))), "$.name"), F.concat(F.lit("u:"), F.col("user_id").cast("string"))).alias("name"))
    return named.orderBy(F.col("n").desc(), "user_id").limit(20).select("name", "n")


def graph_search(spark, sf):
    """The best ten subjects of a fact search, each with the facts shown that have it at either end, reserved ones left out."""
    shown = alias_facts_of(spark, sf).filter("expired_at is null").filter(~gates.reserved(F.col("predicate")))
    seeds = search.head(fact_hits(spark, sf).groupBy("subject_id").agg(F.max("score").alias("score")).withColumnRenamed("subject_id", "id"), 10)
    mine = shown.join(F.broadcast(seeds), F.col("subject_id") == seeds.id).select(seeds.id, "score", shown.id.alias("fact"))
    return mine.groupBy("id", "score").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("fact")), lambda x: x.cast("string"))).alias("facts"))


def search_modes(spark, sf):
    """Five hits of each mode over the same arms."""
    index, near = text_index(spark, sf).search(TERMS), vector.top_k(vectors(spark, sf), first_vector(spark, sf), 15)
    modes = {"content": index, "recall": near, "hybrid": scoring.rrf([(arm(index, 15), 1.0), (arm(near, 15), 1.0)], ["id"], 60)}
    out = None
    for mode, hits in modes.items():
        part = search.head(hits.select("id", "score"), 5).select(F.lit(mode).alias("mode"), "id", F.round("score", 6).alias("score"))
        out = part if out is None else out.union(part)
    return out


def ranks(name: str, source: str, k: int = 30) -> str:
    return f"{name} AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM (SELECT id, score FROM {source} ORDER BY score DESC, id LIMIT {k}))"


def fuse(arms: list[tuple[str, float]], k: float) -> str:
    return "fz AS (SELECT id, round(sum(p), 9) AS score FROM (" + " UNION ALL ".join(f"SELECT id, {w} / ({k} + r + 1) AS p FROM {a}" for a, w in arms) + ") GROUP BY id)"


COS = "round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0)), 6)"
FACT_HITS = ["rendered AS (SELECT id, subject_id, expired_at, concat_ws(' ', predicate, object_value) AS content FROM facts)", *bm25_sql(["purchase", "3"], "rendered", "expired_at IS NULL")]
SHOWN = "rendered AS (SELECT id, expired_at, concat_ws(' ', predicate, object_value) AS content FROM facts WHERE predicate <> 'error')"
NAMED = "nm AS (SELECT id, group_id, concat_ws(' ', name, type_name) AS content FROM names)"
VN = f"vn AS (SELECT id, {COS} AS score FROM vectors)"

QUERIES = {
    "bm25_entities": (bm25_entities, with_sql(NAMES_SQL, NAMED, *bm25_sql(["small"], "nm"), body="SELECT id, score FROM hits ORDER BY score DESC, id LIMIT 50")),
    "fts_join_entities": (fts_join_entities, with_sql(NAMES_SQL, NAMED, "t AS (SELECT id, group_id, unnest(list_distinct(" + "list_filter(list_transform(regexp_split_to_array(lower(content), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')), lambda w: w <> '')" + ")) AS term FROM nm)", body="SELECT id, term, group_id FROM t WHERE term IN ('ring', 'gear') AND (group_id IN ('Brand#2', 'Brand#3', 'Brand#4') OR group_id IS NULL)")),
    "vector_topk_facts": (vector_topk_facts, with_sql(VECTORS_SQL, FACTS_SQL, body=f"SELECT v.id, {COS} AS score FROM vectors v JOIN facts f ON f.id = v.id WHERE f.expired_at IS NULL ORDER BY score DESC, v.id LIMIT 10")),
    "vector_topk_episodes": (vector_topk_episodes, with_sql(VECTORS_SQL, EPISODES_SQL, body=f"SELECT v.id, {COS} AS score FROM vectors v JOIN episodes e ON e.id = v.id WHERE timestamp <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY score DESC, v.id LIMIT 10")),
    "ann_nearest": (ann_nearest, None),
    "ann_fallback": (ann_fallback, with_sql(VECTORS_SQL, body="SELECT x.id, y.id AS other_id, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS score, CAST(row_number() OVER (PARTITION BY x.id ORDER BY round(list_cosine_similarity(x.embedding, y.embedding), 6) DESC, y.id) AS BIGINT) AS rank FROM vectors x JOIN vectors y ON y.id <> x.id WHERE x.id % 100 = 0 QUALIFY rank <= 5")),
    "index_fetch_sizes": (index_fetch_sizes, with_sql(VECTORS_SQL, "t AS (SELECT count(*) AS total FROM vectors)", body="SELECT group_id, CAST(greatest(10, least((SELECT total FROM t), ceil(10.0 * (SELECT total FROM t) / count(*)))) AS BIGINT) AS fetch FROM vectors GROUP BY group_id")),
    "rrf_facts": (rrf_facts, with_sql(VECTORS_SQL, FACTS_SQL, *FACT_HITS, f"vf AS (SELECT v.id, {COS} AS score FROM vectors v JOIN facts f ON f.id = v.id WHERE f.expired_at IS NULL)", ranks("ra", "vf"), ranks("rb", "hits"), fuse([("ra", 1.0), ("rb", 1.0)], 60), body="SELECT id, score FROM fz ORDER BY score DESC, id LIMIT 10")),
    "rrf_content_streams": (rrf_content_streams, with_sql(VECTORS_SQL, EPISODES_SQL, *bm25_sql(TERMS), f"ve AS (SELECT v.id, {COS} AS score FROM vectors v JOIN episodes e ON e.id = v.id)", ranks("ra", "hits"), ranks("rb", "ve"), fuse([("ra", 1.0), ("rb", 1.0)], 1), body="SELECT id, score FROM fz")),
    "rrf_with_facts": (rrf_with_facts, with_sql(VECTORS_SQL, FACTS_SQL, SHOWN, *bm25_sql(["view"], "rendered", "expired_at IS NULL"), VN, ranks("r1", "vn"), ranks("r2", "hits"), "ra AS (SELECT CAST(id AS VARCHAR) AS id, r FROM r1)", "rb AS (SELECT 'fact:' || id AS id, r FROM r2)", fuse([("ra", 1.0), ("rb", 1.0)], 60), body="SELECT id, score FROM fz")),
    "rrf_merge": (rrf_merge, with_sql("a AS (SELECT p_partkey AS id, -p_partkey AS score FROM part WHERE p_partkey <= 20)", "b AS (SELECT p_partkey AS id, p_partkey AS score FROM part WHERE p_partkey BETWEEN 11 AND 30)", ranks("ra", "a"), ranks("rb", "b"), fuse([("ra", 1.0), ("rb", 1.0)], 60), body="SELECT id, score FROM fz ORDER BY score DESC, id LIMIT 15")),
    "raw_recall": (raw_recall, with_sql(VECTORS_SQL, EPISODES_SQL, *bm25_sql(TERMS, where="group_id IN ('en', 'de')"), VN, ranks("ra", "hits"), ranks("rb", "vn"), fuse([("ra", 0.5), ("rb", 0.5)], 1), "t AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS place FROM fz ORDER BY score DESC, id LIMIT 10)", body="SELECT id, score, CAST(row_number() OVER (ORDER BY CASE WHEN place <= 3 THEN -id END DESC NULLS LAST, place) AS BIGINT) AS rank FROM t")),
    "top_names_by_access": (top_names_by_access, "SELECT CASE WHEN user_id % 2 = 0 THEN 'User ' || user_id ELSE 'u:' || user_id END AS name, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 20"),
    "graph_search": (graph_search, with_sql(FACTS_SQL, *FACT_HITS, "s AS (SELECT subject_id AS id, max(score) AS score FROM hits GROUP BY 1 ORDER BY score DESC, id LIMIT 10)", body="SELECT s.id, s.score, string_agg(CAST(f.id AS VARCHAR), ',' ORDER BY f.id) AS facts FROM s JOIN facts f ON f.subject_id = s.id WHERE f.expired_at IS NULL AND predicate <> 'error' GROUP BY s.id, s.score")),
    "search_modes": (search_modes, with_sql(VECTORS_SQL, EPISODES_SQL, *bm25_sql(TERMS), VN, ranks("ra", "hits", 15), ranks("rb", "vn", 15), fuse([("ra", 1.0), ("rb", 1.0)], 60), body="SELECT * FROM (SELECT 'content' AS mode, id, round(score, 6) AS score FROM hits ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'recall', id, score FROM vn ORDER BY score DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'hybrid', id, round(score, 6) FROM fz ORDER BY score DESC, id LIMIT 5)")),
}
