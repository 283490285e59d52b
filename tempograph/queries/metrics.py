"""Evaluation metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import scoring, text
from tempograph.operators import search, windows
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, episodes, facts, raw, with_sql

from .scalar import tok


def f1_sets(spark, sf):
    """Words of each conversation turn against those of the one before."""
    before = raw(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("other is not null")
    a, b = F.array_distinct(text.tokens(F.col("other"))), F.array_distinct(text.tokens(F.col("text")))
    tp, fp, fn, p, r, f = scoring.f1(a, b)
    return before.select("conv_id", "turn", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def word_overlap(spark, sf):
    before = raw(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("other is not null")
    a, b = F.array_distinct(text.tokens(F.col("other"))), text.tokens(F.col("text"))
    return before.select("conv_id", "turn", F.round(F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0), 6).alias("overlap"))


def wilson(spark, sf):
    g = raw(spark, sf, "labels").groupBy("quality").agg(F.sum("toxic").alias("hits"), F.count("*").alias("n"))
    low, high = scoring.wilson(F.col("hits"), F.col("n"))
    return g.select("quality", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def ranked_gold(spark, sf):
    """Facts of each subject in time order; gold are those of high confidence."""
    order = Window.partitionBy("subject_id").orderBy("valid_from", "id")
    return facts(spark, sf).select("subject_id", F.row_number().over(order).alias("rank"), (F.col("confidence") >= 0.9).alias("gold"))


def mrr_recall_at_k(spark, sf):
    r = ranked_gold(spark, sf).groupBy("subject_id").agg(F.min(F.when(F.col("gold"), F.col("rank"))).alias("first"))
    return r.agg(
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        *[F.round(F.avg((F.coalesce("first", F.lit(10**9)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in (1, 5, 10)],
    )


def ndcg_at_10(spark, sf):
    r = ranked_gold(spark, sf)
    dcg = F.sum(F.when(F.col("gold") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    per = r.groupBy("subject_id").agg(dcg.alias("dcg"), F.sum(F.col("gold").cast("int")).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n"), F.lit(10)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select("subject_id", F.round(F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


def percentiles(spark, sf):
    """The value at a rounded place of the sorted list, by event type."""
    e = raw(spark, sf, "events").select("event_type", "value")
    return windows.values_at(e, "event_type", "value", {"p50": F.floor(F.col("n") / 2), "p95": F.floor((F.col("n") - 1) * 95 / 100 + 0.5)})


def mean_and_sd(spark, sf):
    return raw(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("sd"))


def cost_rollup(spark, sf):
    words = episodes(spark, sf).select("source_id", F.size(text.tokens(F.col("content"))).cast("long").alias("tokens"))
    return words.groupBy("source_id").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / 1000 * 0.15, 6).alias("usd"))


def mcnemar_counts(spark, sf):
    j = raw(spark, sf, "labels")
    return j.agg(F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("b"), F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("c"), F.count("*").alias("n"))


def access_counts(spark, sf):
    return raw(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("accesses"))


def budget_ledger(spark, sf):
    e = windows.running_sum(episodes(spark, sf).select("id", "source_id", F.octet_length("content").cast("long").alias("size")), ["source_id"], "id", F.col("size"), "spent")
    return e.select("id", "source_id", "spent", (F.col("spent") > 50_000).alias("over"))


def fuzzy_matches(spark, sf):
    """Benchmark passages that an episode holds, in any case."""
    b = raw(spark, sf, "benchmark").select("item_id", F.lower("text").alias("passage"))
    e = episodes(spark, sf).select("id", F.lower("content").alias("low"))
    return search.containing(e, "low", b, "passage").select("id", "item_id")


TA, TB = f"list_distinct({tok('other')})", f"list_distinct({tok('text')})"
BEFORE = "b AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS other FROM conversations)"
RANKED = "r AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY valid_from, id) AS rank, confidence >= 0.9 AS gold FROM facts)"

QUERIES = {
    "f1_sets": (f1_sets, with_sql(BEFORE, f"s AS (SELECT conv_id, turn, len(list_intersect({TA}, {TB})) AS tp, len({TA}) AS na, len({TB}) AS nb FROM b WHERE other IS NOT NULL)", "q AS (SELECT conv_id, turn, tp, nb - tp AS fp, na - tp AS fn, CASE WHEN nb > 0 THEN tp / nb::DOUBLE WHEN na = tp THEN 1.0 ELSE 0.0 END AS p, CASE WHEN na > 0 THEN tp / na::DOUBLE ELSE 1.0 END AS r FROM s)", body="SELECT conv_id, turn, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM q")),
    "word_overlap": (word_overlap, with_sql(BEFORE, f"s AS (SELECT conv_id, turn, {TA} AS a, {TB} AS b FROM b WHERE other IS NOT NULL)", body="SELECT conv_id, turn, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a)::DOUBLE ELSE 0.0 END, 6) AS overlap FROM s")),
    "wilson": (wilson, "WITH g AS (SELECT quality, CAST(sum(toxic) AS BIGINT) AS hits, count(*) AS n FROM labels GROUP BY quality), p AS (SELECT *, hits / n::DOUBLE AS p FROM g), m AS (SELECT *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) AS mid, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) AS half FROM p) SELECT quality, hits, n, round(greatest(mid - half, 0.0), 6) AS low, round(least(mid + half, 1.0), 6) AS high FROM m"),
    "mrr_recall_at_k": (mrr_recall_at_k, with_sql(FACTS_SQL, RANKED, "f AS (SELECT subject_id, min(CASE WHEN gold THEN rank END) AS f FROM r GROUP BY subject_id)", body="SELECT round(avg(coalesce(1.0 / f, 0.0)), 6) AS mrr, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_5, round(avg(CASE WHEN f <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_10 FROM f")),
    "ndcg_at_10": (ndcg_at_10, with_sql(FACTS_SQL, RANKED, "d AS (SELECT subject_id, sum(CASE WHEN gold AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0.0 END) AS dcg, sum(CASE WHEN gold THEN 1 ELSE 0 END) AS n FROM r GROUP BY subject_id)", body="SELECT subject_id, round(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(n, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END, 6) AS ndcg FROM d")),
    "percentiles": (percentiles, "WITH k AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN k = n // 2 THEN value END) AS p50, max(CASE WHEN k = floor((n - 1) * 95 / 100.0 + 0.5) THEN value END) AS p95 FROM k GROUP BY event_type"),
    "mean_and_sd": (mean_and_sd, "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0.0), 6) AS sd FROM events GROUP BY event_type"),
    "cost_rollup": (cost_rollup, with_sql(EPISODES_SQL, f"t AS (SELECT source_id, CAST(sum(len({tok('content')})) AS BIGINT) AS tokens FROM episodes GROUP BY source_id)", body="SELECT source_id, tokens, round(tokens / 1000.0 * 0.15, 6) AS usd FROM t")),
    "mcnemar_counts": (mcnemar_counts, "SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c, count(*) AS n FROM labels"),
    "access_counts": (access_counts, "SELECT user_id, count(*) AS accesses FROM events GROUP BY user_id"),
    "budget_ledger": (budget_ledger, with_sql(EPISODES_SQL, "s AS (SELECT id, source_id, CAST(sum(strlen(content)) OVER (PARTITION BY source_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM episodes)", body="SELECT id, source_id, spent, spent > 50000 AS over FROM s")),
    "fuzzy_matches": (fuzzy_matches, with_sql(EPISODES_SQL, body="SELECT e.id, b.item_id FROM episodes e JOIN benchmark b ON contains(lower(e.content), lower(b.text))")),
}
