"""Evaluation: paired tests, graded ranks, judged ratios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import scoring, text
from tempograph.sources.adapters import FACTS_SQL, facts, raw, with_sql

from .metrics import BEFORE
from .scalar import tok


def mcnemar(spark, sf):
    """Two systems' answers paired by question: what only one got right, and the exact two-sided chance of that."""
    e = raw(spark, sf, "events")
    a = e.select(F.col("event_id").alias("q"), (F.col("event_id") % 9 < 7).alias("a_right"), F.col("event_type").alias("category"))
    b = e.filter("event_id % 10 <> 3").select(F.col("event_id").alias("q"), (F.col("user_id") % 9 < 6).alias("b_right"))
    counted = a.join(b, "q").groupBy("category").agg(F.count_if(F.col("a_right") & ~F.col("b_right")).alias("b"), F.count_if(~F.col("a_right") & F.col("b_right")).alias("c"))
    return counted.select("category", "b", "c", F.round(scoring.mcnemar_p(F.col("b"), F.col("c")), 6).alias("p"))


def fuzzy_f1(spark, sf):
    """Words of a turn found in those of the one before, either as a part of the other."""
    t = raw(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("other is not null")
    cut = lambda c: F.slice(F.array_sort(F.array_distinct(F.filter(text.tokens(F.col(c)), lambda w: F.length(w) > 2))), 1, 20)
    tp, fp, fn = scoring.fuzzy_counts(F.col("expected"), F.col("given"))
    return t.select("conv_id", "turn", cut("other").alias("expected"), cut("text").alias("given")).select("conv_id", "turn", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))


def gains_of(spark, sf):
    """Facts of each user as a retrieved list, each holding some of the five evidence turns."""
    order = Window.partitionBy("subject_id").orderBy("valid_from", "id")
    held = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda t: (F.col("id") + t * t) % 7 == 0)
    f = facts(spark, sf).select("subject_id", "group_id", "id", F.row_number().over(order).alias("rank"), held.alias("held"))
    return f.filter("rank <= 10").withColumn("gain", F.size("held"))


def evidence_recall(spark, sf):
    """Recall of evidence turns, graded nDCG and reciprocal rank, by category and over all."""
    g = gains_of(spark, sf)
    ideal = Window.partitionBy("subject_id").orderBy(F.col("gain").desc(), "rank")
    g = g.withColumn("place", F.row_number().over(ideal))
    per = g.groupBy("subject_id", "group_id").agg(
        (F.size(F.array_distinct(F.flatten(F.collect_list("held")))) / 5).alias("recall"),
        F.sum(F.col("gain") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("gain") / F.log2(F.col("place") + 1)).alias("idcg"),
        F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"),
    )
    scored = per.select("group_id", "recall", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))
    mean = scored.rollup("group_id").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "ndcg", "rr")])
    return mean.select(F.coalesce("group_id", F.lit("all")).alias("category"), "n", "recall", "ndcg", "rr")


def metric_variance(spark, sf):
    """Mean squared difference of six scores of two runs."""
    p = raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[(((F.col("p_partkey") * (i + 3)) % 10) / 10).alias(f"a{i}") for i in range(6)], *[(((F.col("p_size") * (i + 2)) % 10) / 10).alias(f"b{i}") for i in range(6)])
    return p.select("id", F.round(sum(((F.col(f"a{i}") - F.col(f"b{i}")) * (F.col(f"a{i}") - F.col(f"b{i}")) for i in range(6)), F.lit(0.0)) / 6, 6).alias("variance"))


def merge_chains(spark, sf):
    """Keepers that were merged away themselves, in a chain of parts."""
    m = raw(spark, sf, "part").filter("p_partkey > 1").select(F.col("p_partkey").alias("loser"), F.floor(F.col("p_partkey") / 3).alias("keeper"))
    return m.select(F.col("keeper").alias("id")).intersect(m.select(F.col("loser").alias("id")))


def entities_recall(spark, sf):
    """Share of a turn's long words, as its entities, that the turn before has; no model needed."""
    t = raw(spark, sf, "conversations").withColumn("other", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("other is not null")
    names = F.array_distinct(F.filter(text.tokens(F.col("text")), lambda w: F.length(w) >= 6))
    found = F.size(F.array_intersect(names, text.tokens(F.col("other"))))
    return t.select("conv_id", "turn", F.round(F.when(F.size(names) > 0, found / F.size(names)).otherwise(1.0), 6).alias("recall"))


def judged_ratios(spark, sf):
    """Ratios of verdicts per question, as a judge's scorers make them: faithful claims, useful contexts."""
    v = raw(spark, sf, "labels").withColumn("question", F.floor(F.col("doc_id") / 8))
    return v.groupBy("question").agg(F.round(F.avg((F.col("quality") == 1).cast("double")), 6).alias("faithfulness"), F.round(F.avg((F.col("toxic") == 0).cast("double")), 6).alias("precision"), F.count("*").alias("n"))


CUT = "list_sort(list_distinct(list_filter({0}, lambda w: length(w) > 2)))[1:20]"
TAIL = "least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))))"

QUERIES = {
    "mcnemar": (mcnemar, f"WITH j AS (SELECT event_type AS category, event_id % 9 < 7 AS x, user_id % 9 < 6 AS y FROM events WHERE event_id % 10 <> 3), k AS (SELECT category, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c FROM j GROUP BY category) SELECT category, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE {TAIL} END, 6) AS p FROM k"),
    "fuzzy_f1": (fuzzy_f1, with_sql(BEFORE, f"l AS (SELECT conv_id, turn, {CUT.format(tok('other'))} AS e, {CUT.format(tok('text'))} AS g FROM b WHERE other IS NOT NULL)", body="SELECT conv_id, turn, CAST(len(list_filter(e, lambda x: len(list_filter(g, lambda y: contains(x, y) OR contains(y, x))) > 0)) AS BIGINT) AS tp, CAST(len(list_filter(g, lambda y: len(list_filter(e, lambda x: contains(x, y) OR contains(y, x))) = 0)) AS BIGINT) AS fp, CAST(len(list_filter(e, lambda x: len(list_filter(g, lambda y: contains(x, y) OR contains(y, x))) = 0)) AS BIGINT) AS fn FROM l")),
    "evidence_recall": (evidence_recall, with_sql(FACTS_SQL, "r AS (SELECT subject_id, group_id, id, row_number() OVER (PARTITION BY subject_id ORDER BY valid_from, id) AS rank, list_filter(range(0, 5), lambda t: (id + t * t) % 7 = 0) AS held FROM facts)", "g AS (SELECT *, len(held) AS gain FROM r WHERE rank <= 10)", "q AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY gain DESC, rank) AS place FROM g)", "s AS (SELECT subject_id, group_id, len(list_distinct(flatten(list(held)))) / 5.0 AS recall, sum(gain / log2(rank + 1)) AS dcg, sum(gain / log2(place + 1)) AS idcg, min(CASE WHEN gain > 0 THEN rank END) AS first FROM q GROUP BY 1, 2)", "t AS (SELECT group_id, recall, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg, coalesce(1.0 / first, 0.0) AS rr FROM s)", body="SELECT coalesce(group_id, 'all') AS category, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM t GROUP BY ROLLUP (group_id)")),
    "metric_variance": (metric_variance, "SELECT p_partkey AS id, round((" + " + ".join(f"pow((p_partkey * {i + 3}) % 10 / 10.0::DOUBLE - (p_size * {i + 2}) % 10 / 10.0::DOUBLE, 2)" for i in range(6)) + ") / 6, 6) AS variance FROM part"),
    "merge_chains": (merge_chains, "SELECT p_partkey // 3 AS id FROM part WHERE p_partkey > 1 INTERSECT SELECT p_partkey FROM part WHERE p_partkey > 1"),
    "entities_recall": (entities_recall, with_sql(BEFORE, f"l AS (SELECT conv_id, turn, list_distinct(list_filter({tok('text')}, lambda w: length(w) >= 6)) AS e, {tok('other')} AS o FROM b WHERE other IS NOT NULL)", body="SELECT conv_id, turn, round(CASE WHEN len(e) > 0 THEN len(list_intersect(e, o)) / len(e)::DOUBLE ELSE 1.0 END, 6) AS recall FROM l")),
    "judged_ratios": (judged_ratios, "SELECT doc_id // 8 AS question, round(avg(CASE WHEN quality = 1 THEN 1.0 ELSE 0.0 END), 6) AS faithfulness, round(avg(CASE WHEN toxic = 0 THEN 1.0 ELSE 0.0 END), 6) AS precision, count(*) AS n FROM labels GROUP BY 1"),
}
