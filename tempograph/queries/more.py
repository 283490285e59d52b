"""Readers, answers, keys, logs and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import parsing, scoring, text
from tempograph.operators import mutate
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, NAMES_SQL, episodes, facts, names, raw, with_sql

from .scalar import norm, tok


def label_validity(spark, sf):
    return names(spark, sf).select("id", parsing.structural_label(F.col("name")).alias("valid"), parsing.canonical_label(F.col("type_name")).alias("canonical"))


def index_lists(spark, sf):
    made = F.concat(F.lit("picks: ["), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"), F.lit("] of "), F.col("event_type"))
    return raw(spark, sf, "events").select("event_id", F.array_join(F.transform(parsing.index_list(made), lambda x: x.cast("string")), "|").alias("found"))


def fenced_json(spark, sf):
    body = parsing.first_object(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return raw(spark, sf, "events").select("event_id", F.get_json_object(body, "$.k").cast("bigint").alias("k"))


def session_dates(spark, sf):
    stamp = F.concat(((F.col("event_id") % 12) + 1).cast("string"), F.when(F.col("event_id") % 2 == 0, ":05 pm on ").otherwise(":05 AM on "), ((F.col("event_id") % 28) + 1).cast("string"), F.lit(" "), F.element_at(F.array(*[F.initcap(F.lit(m)) for m in text.MONTHS]), (F.col("event_id") % 11 + 1).cast("int")), F.lit(", 2023"))
    given = F.when(F.col("event_id") % 10 == 0, "next tuesday").otherwise(stamp)
    return raw(spark, sf, "events").select("event_id", parsing.session_date(given).alias("at"))


def turn_scores(spark, sf):
    """Each conversation turn as an answer to the one before."""
    before = raw(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("other is not null")
    return before.select("conv_id", "turn", parsing.exact_match(F.col("text"), F.col("other")).alias("exact"), F.round(parsing.token_f1(F.col("text"), F.col("other")), 6).alias("f1"), F.round(parsing.quick_score(F.col("text"), F.col("other")), 6).alias("score"))


def item_credit(spark, sf):
    items = F.array(F.lit("the"), F.lit("of the"), F.lit("de la"), F.lit("und der"))
    return episodes(spark, sf).select("id", F.round(parsing.item_credit(items, F.col("content")), 6).alias("credit"))


def rate_lookup(spark, sf):
    model = F.when(F.col("p_partkey") % 3 == 0, "gpt-4o-mini-2024").when(F.col("p_partkey") % 3 == 1, "gpt-4o").otherwise("other")
    p = raw(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.round(F.col("p_size") / 1000 * parsing.rate(model, 0) + F.col("p_retailprice") / 1000 * parsing.rate(model, 1), 6).alias("usd"))


def idempotency_keys(spark, sf):
    n = names(spark, sf)
    return n.select("id", parsing.idempotency_key(F.col("id").cast("string"), F.col("name"), F.col("type_name"), F.col("group_id")).alias("key"), parsing.pair_key(F.col("name"), F.col("type_name")).alias("pair"))


def question_categories(spark, sf):
    e = raw(spark, sf, "events")
    kinds = ("multi-session", "temporal-reasoning", "knowledge-update", "single-session-user", "single-session-assistant", "single-session-preference", "other")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("user_id") % 7 + 1).cast("int"))
    asked = F.element_at(F.array(F.lit("temporal"), F.lit("multi-hop"), F.lit("open-domain")), (F.col("event_id") % 3 + 1).cast("int"))
    qid = F.when(F.col("event_id") % 5 == 0, F.concat(F.col("event_id").cast("string"), F.lit("_abs"))).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", parsing.category(kind, qid).alias("category"), parsing.recall_limit(asked).cast("long").alias("k"))


def shouted_words(spark, sf):
    return raw(spark, sf, "orders").select("o_orderkey", parsing.shouted(F.col("o_orderpriority")).alias("priority"))


def verdict_values(spark, sf):
    v = F.when(F.col("toxic") == 1, "correct").when(F.col("quality") == 1, "partial").otherwise("wrong")
    return raw(spark, sf, "labels").agg(F.sum(parsing.verdict_value(v)).alias("total"), F.count("*").alias("n"))


def mutation_log(spark, sf):
    log = raw(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 == 0, F.col("ts")).alias("undone_at"))
    return mutate.log_view(log, kind="click").select("id", "created_at")


def metadata_patch(spark, sf):
    e = raw(spark, sf, "events").select("event_id", mutate.patched(F.col("props"), {"source": F.concat(F.lit("s"), (F.col("event_id") % 9).cast("string"))}).alias("m"))
    return e.select("event_id", F.get_json_object("m", "$.source").alias("source"), F.get_json_object("m", "$.k").cast("bigint").alias("k"))


def net_mutations(spark, sf):
    f = facts(spark, sf).groupBy("group_id").agg(F.count_if(F.col("valid_to").isNotNull()).alias("superseded"), F.count_if(F.col("expired_at").isNotNull()).alias("archived"))
    return f.select("group_id", (F.col("superseded") + F.col("archived")).alias("total"), ((F.col("superseded") + F.col("archived")) > 50).alias("warn"))


def axis_reorders(spark, sf):
    """Whether a bonus for degree changes the order of seeds, by namespace."""
    p = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), (F.col("p_retailprice") % 100 / 100).alias("score"), F.col("p_size").alias("d"))
    p = p.withColumn("with", F.round("score", 6) + F.round(scoring.saturating(F.col("d"), 0.5, 25), 6))
    a = F.row_number().over(Window.partitionBy("g").orderBy(F.round("score", 6).desc(), "id"))
    b = F.row_number().over(Window.partitionBy("g").orderBy(F.round("with", 6).desc(), "id"))
    return p.select("g", (a != b).alias("x")).groupBy("g").agg(F.max(F.col("x").cast("int")).alias("reorders"))


def proximity(spark, sf):
    n = raw(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.select("o_custkey", F.round(scoring.saturating(F.col("n"), 0.1, 20), 6).alias("bonus"), parsing.effective_k(F.lit(10), F.col("n")).cast("long").alias("k"))


def state_moves(spark, sf):
    e = raw(spark, sf, "events")
    names_ = F.array(*[F.lit(x) for x in ("pending", "phase1", "verified", "facts", "done", "failed", "cancelled")])
    old, new = F.element_at(names_, (F.col("event_id") % 7 + 1).cast("int")), F.element_at(names_, (F.col("user_id") % 7 + 1).cast("int"))
    return e.select("event_id", old.alias("old"), new.alias("new"), parsing.may_follow(old, new).alias("ok"))


def pmi_bigrams(spark, sf):
    """Pairs of neighbouring words by how much more often they meet than by chance."""
    w = episodes(spark, sf).select(text.tokens(F.col("content")).alias("w")).filter(F.size("w") > 1)
    pairs = w.select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p")).select("p.a", "p.b")
    n = pairs.agg(F.count("*").alias("n"))
    ab = pairs.groupBy("a", "b").agg(F.count("*").alias("ab")).filter("ab >= 20")
    a, b = pairs.groupBy("a").agg(F.count("*").alias("na")), pairs.groupBy("b").agg(F.count("*").alias("nb"))
    j = ab.join(a, "a").join(b, "b").crossJoin(F.broadcast(n))
    return j.select("a", "b", F.round(F.log2(F.col("ab") * F.col("n") / (F.col("na") * F.col("nb").cast("double"))), 6).alias("pmi"))


def set_operations(spark, sf):
    """Customers and orders' customers: union, intersection and difference sizes."""
    a = raw(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    b = raw(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    size = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return size(a.union(b).distinct(), "union").union(size(a.intersect(b), "intersect")).union(size(a.subtract(b), "except"))


F1B = f"a AS (SELECT conv_id, turn, text, other, {tok('text')} AS h, {tok('other')} AS r FROM b WHERE other IS NOT NULL), c AS (SELECT *, list_sum(list_transform(list_distinct(h), lambda w: least(len(list_filter(h, lambda x: x = w)), len(list_filter(r, lambda x: x = w))))) AS common FROM a), f AS (SELECT *, CASE WHEN len(h) = 0 OR len(r) = 0 OR common = 0 THEN 0.0 ELSE 2.0 * (common / len(h)::DOUBLE) * (common / len(r)::DOUBLE) / (common / len(h)::DOUBLE + common / len(r)::DOUBLE) END AS f1 FROM c)"
BEFORE = "b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations)"
STATES = "['pending', 'phase1', 'verified', 'facts', 'done', 'failed', 'cancelled']"

QUERIES = {
    "label_validity": (label_validity, with_sql(NAMES_SQL, body="SELECT id, strlen(name) BETWEEN 2 AND 64 AND regexp_matches(name, '^[A-Za-z_][A-Za-z0-9_ ]*$') AND regexp_matches(name, '[A-Za-z]') AS valid, strlen(type_name) BETWEEN 2 AND 64 AND regexp_matches(type_name, '^[A-Za-z_][A-Za-z0-9_ ]*$') AND regexp_matches(type_name, '[A-Za-z]') AND lower(type_name) NOT IN ('entity', 'unknown') AS canonical FROM names")),
    "index_lists": (index_lists, "SELECT event_id, event_id || '|' || user_id AS found FROM events"),
    "fenced_json": (fenced_json, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "session_dates": (session_dates, "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN make_timestamp(2023, event_id % 11 + 1, event_id % 28 + 1, (event_id % 12 + 1) % 12 + CASE WHEN event_id % 2 = 0 THEN 12 ELSE 0 END, 5, 0.0) END AS at FROM events"),
    "turn_scores": (turn_scores, with_sql(BEFORE, F1B, body=f"SELECT conv_id, turn, lower(trim(text)) = lower(trim(other)) AS exact, round(f1, 6) AS f1, round(CASE WHEN {norm('text')} = '' THEN 0.0 WHEN {norm('text')} = {norm('other')} THEN 1.0 WHEN contains({norm('text')}, {norm('other')}) AND {norm('other')} <> '' THEN 1.0 ELSE f1 END, 6) AS score FROM f")),
    "item_credit": (item_credit, with_sql(EPISODES_SQL, f"t AS (SELECT id, lower(content) AS low, {tok('content')} AS w FROM episodes)", body="SELECT id, round(((CASE WHEN contains(low, 'the') OR list_contains(w, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(low, 'of the') OR list_contains(w, 'of') OR list_contains(w, 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(low, 'de la') OR list_contains(w, 'de') OR list_contains(w, 'la') THEN 1 ELSE 0 END) + (CASE WHEN contains(low, 'und der') OR list_contains(w, 'und') OR list_contains(w, 'der') THEN 1 ELSE 0 END)) / 4.0::DOUBLE, 6) AS credit FROM t")),
    "rate_lookup": (rate_lookup, "SELECT p_partkey AS id, round(p_size / 1000.0::DOUBLE * CASE p_partkey % 3 WHEN 0 THEN 0.15::DOUBLE WHEN 1 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END + p_retailprice / 1000 * CASE p_partkey % 3 WHEN 0 THEN 0.6::DOUBLE WHEN 1 THEN 10.0::DOUBLE ELSE 2.0::DOUBLE END, 6) AS usd FROM part"),
    "idempotency_keys": (idempotency_keys, with_sql(NAMES_SQL, body="SELECT id, sha256(concat_ws('␟', CAST(id AS VARCHAR), name, type_name, group_id)) AS key, sha256(least(name, type_name) || '|' || greatest(name, type_name)) AS pair FROM names")),
    "question_categories": (question_categories, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'Abstention' WHEN user_id % 7 = 0 THEN 'MultiSession' WHEN user_id % 7 = 1 THEN 'TemporalReasoning' WHEN user_id % 7 = 2 THEN 'KnowledgeUpdate' ELSE 'InformationExtraction' END AS category, CAST(CASE event_id % 3 WHEN 0 THEN 30 WHEN 1 THEN 40 ELSE 20 END AS BIGINT) AS k FROM events"),
    "shouted_words": (shouted_words, "SELECT o_orderkey, replace(o_orderpriority, 'SPECIFIED', 'Specified') AS priority FROM orders"),
    "verdict_values": (verdict_values, "SELECT sum(CASE WHEN toxic = 1 THEN 1.0 WHEN quality = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE AS total, count(*) AS n FROM labels"),
    "mutation_log": (mutation_log, "SELECT event_id AS id, ts AS created_at FROM events WHERE event_type = 'click' AND event_id % 4 <> 0"),
    "metadata_patch": (metadata_patch, "SELECT event_id, 's' || (event_id % 9) AS source, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "net_mutations": (net_mutations, with_sql(FACTS_SQL, "s AS (SELECT group_id, count(*) FILTER (WHERE valid_to IS NOT NULL) + count(*) FILTER (WHERE expired_at IS NOT NULL) AS total FROM facts GROUP BY group_id)", body="SELECT group_id, total, total > 50 AS warn FROM s")),
    "axis_reorders": (axis_reorders, "WITH p AS (SELECT p_partkey AS id, p_brand AS g, round(p_retailprice % 100 / 100, 6) AS s, round(0.5::DOUBLE * least(p_size / 25.0::DOUBLE, 1.0), 6) AS d FROM part), r AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS a, row_number() OVER (PARTITION BY g ORDER BY round(s + d, 6) DESC, id) AS b FROM p) SELECT g, max(CASE WHEN a <> b THEN 1 ELSE 0 END) AS reorders FROM r GROUP BY g"),
    "proximity": (proximity, "SELECT o_custkey, round(0.1::DOUBLE * least(count(*) / 20.0::DOUBLE, 1.0), 6) AS bonus, greatest(1, least(10, count(*))) AS k FROM orders GROUP BY o_custkey"),
    "state_moves": (state_moves, f"WITH s AS (SELECT event_id, {STATES}[CAST(event_id % 7 + 1 AS INTEGER)] AS old, {STATES}[CAST(user_id % 7 + 1 AS INTEGER)] AS new, event_id % 7 AS o, user_id % 7 AS n FROM events) SELECT event_id, old, new, CASE WHEN n >= 5 THEN o < 4 ELSE o < 5 AND n = o + 1 END AS ok FROM s"),
    "pmi_bigrams": (pmi_bigrams, with_sql(EPISODES_SQL, f"w AS (SELECT {tok('content')} AS w FROM episodes)", "p AS (SELECT unnest(w[1 : len(w) - 1]) AS a, unnest(w[2 : len(w)]) AS b FROM w WHERE len(w) > 1)", "n AS (SELECT count(*) AS n FROM p)", "ab AS (SELECT a, b, count(*) AS ab FROM p GROUP BY 1, 2 HAVING count(*) >= 20)", "na AS (SELECT a, count(*) AS na FROM p GROUP BY 1)", "nb AS (SELECT b, count(*) AS nb FROM p GROUP BY 1)", body="SELECT ab.a, ab.b, round(log2(ab * n / (na * nb::DOUBLE)), 6) AS pmi FROM ab JOIN na ON na.a = ab.a JOIN nb ON nb.b = ab.b, n")),
    "set_operations": (set_operations, "SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)"),
}
