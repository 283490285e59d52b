"""World-time predicates, histories and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import temporal
from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, episodes, facts, raw, with_sql

AT = "2024-01-15 12:00:00"
NOW = "2024-02-05 00:00:00"
VALID = "valid_from <= TIMESTAMP '{0}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{0}') AND expired_at IS NULL"
COLUMNS = ["id", "subject_id", "predicate", "object_value", "valid_from", "valid_to"]


def facts_at(spark, sf):
    return temporal.facts_at(facts(spark, sf), temporal.instant(AT)).select(*COLUMNS)


def entity_facts_at(spark, sf):
    return facts_at(spark, sf).filter("subject_id = 'u:8'")


def entity_history(spark, sf):
    return temporal.history(facts(spark, sf)).select("id", "subject_id", "version", "valid_from", "next_from")


def known_at(spark, sf):
    return facts(spark, sf).filter(temporal.known_at(temporal.instant(AT))).select("id", "subject_id", "recorded_at", "expired_at")


def asof_batch_range_join(spark, sf):
    times = raw(spark, sf, "orders").select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(o_orderkey % 30 as int))").alias("t")).distinct()
    return temporal.facts_at_times(facts(spark, sf), times).groupBy("t", "predicate").agg(F.count("*").alias("n"))


def interval_overlap_neighbours(spark, sf):
    pairs = temporal.overlapping_neighbours(facts(spark, sf).withColumn("valid_to", F.expr("valid_from + interval 6 hours")), ["subject_id"])
    return pairs.select(F.col("other.id").alias("a"), F.col("id").alias("b"), "subject_id")


def interval_overlap_pairs(spark, sf):
    pairs = temporal.overlapping_pairs(facts(spark, sf).withColumn("valid_to", F.expr("valid_from + interval 6 hours")), ["subject_id"])
    return pairs.select(F.col("other.id").alias("a"), F.col("id").alias("b"), "subject_id")


def window_closeout(spark, sf):
    return temporal.close_out(facts(spark, sf), temporal.instant(NOW)).select("id", "valid_to", "expired_at")


def bitemporal_latest(spark, sf):
    return temporal.latest(facts(spark, sf), ["subject_id", "predicate"], [F.col("valid_from").desc(), F.col("id").desc()]).select(*COLUMNS)


def top3_latest_facts(spark, sf):
    return temporal.latest(facts(spark, sf), ["subject_id"], [F.col("recorded_at").desc(), F.col("id").desc()], 3).select("id", "subject_id", "recorded_at")


def prior_episodes_for_source(spark, sf):
    order = Window.partitionBy("source_id").orderBy(F.col("id"))
    before = episodes(spark, sf).withColumn("prior", F.concat_ws(",", F.collect_list("id").over(order.rowsBetween(-10, -1))))
    return before.select("id", "source_id", "prior")


def ghost_episodes(spark, sf):
    live = facts(spark, sf).select(F.col("source_episode_id").alias("id"))
    return episodes(spark, sf).select("id", "group_id").join(live, "id", "left_anti")


def episodes_as_of(spark, sf):
    return episodes(spark, sf).filter(F.col("timestamp") <= temporal.instant("2024-01-20 00:00:00")).select("id", "group_id", "timestamp")


def episodes_since(spark, sf):
    return episodes(spark, sf).filter(F.col("timestamp") > temporal.instant("2024-01-20 00:00:00")).groupBy("group_id").agg(F.count("*").alias("n"))


def world_time_audit(spark, sf):
    f, e = facts(spark, sf), episodes(spark, sf).select(F.col("id").alias("source_episode_id"), "timestamp")
    both = f.join(e, "source_episode_id")
    day = F.to_date("valid_from")
    ep_day = F.to_date("timestamp")
    return both.groupBy("predicate").agg(
        F.count("*").alias("n"),
        F.countDistinct(day).alias("days"),
        F.sum(F.when(day < ep_day, 1).otherwise(0)).alias("back"),
        F.sum(F.when(day > ep_day, 1).otherwise(0)).alias("forward"),
        F.sum(F.when(day == ep_day, 1).otherwise(0)).alias("same"),
    )


def event_windows(spark, sf):
    """Tumbling six-hour windows, beyond what is asked for."""
    w = F.window(F.col("valid_from").cast("timestamp"), "6 hours")
    return facts(spark, sf).groupBy(w.alias("w"), "predicate").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "predicate", "n")


def supersession_candidates(spark, sf):
    f = facts(spark, sf)
    now = temporal.instant(NOW)
    due = F.col("expired_at").isNull() & (F.col("valid_to") < now)
    stats = f.groupBy("group_id").agg(F.sum(due.cast("long")).alias("candidates"), F.sum(F.col("expired_at").isNull().cast("long")).alias("live"))
    from tempograph.functions.scoring import decide_bulk

    return stats.select("group_id", "candidates", "live", decide_bulk(F.col("candidates"), F.col("live")).alias("decision"))


QUERIES = {
    "facts_at": (facts_at, with_sql(FACTS_SQL, body=f"SELECT {', '.join(COLUMNS)} FROM facts WHERE {VALID.format(AT)}")),
    "entity_facts_at": (entity_facts_at, with_sql(FACTS_SQL, body=f"SELECT {', '.join(COLUMNS)} FROM facts WHERE subject_id = 'u:8' AND {VALID.format(AT)}")),
    "entity_history": (entity_history, with_sql(FACTS_SQL, body="SELECT id, subject_id, CAST(row_number() OVER w AS BIGINT) AS version, valid_from, lead(valid_from) OVER w AS next_from FROM facts WINDOW w AS (PARTITION BY subject_id ORDER BY valid_from, recorded_at, id)")),
    "known_at": (known_at, with_sql(FACTS_SQL, body=f"SELECT id, subject_id, recorded_at, expired_at FROM facts WHERE recorded_at <= TIMESTAMP '{AT}' AND (expired_at IS NULL OR expired_at > TIMESTAMP '{AT}')")),
    "asof_batch_range_join": (asof_batch_range_join, with_sql(FACTS_SQL, "times AS (SELECT DISTINCT TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o_orderkey % 30 AS INTEGER)) AS t FROM orders)", body="SELECT t, predicate, count(*) AS n FROM facts JOIN times ON valid_from <= t AND (valid_to IS NULL OR valid_to > t) WHERE expired_at IS NULL GROUP BY t, predicate")),
    "interval_overlap_neighbours": (interval_overlap_neighbours, with_sql(FACTS_SQL, "p AS (SELECT id AS b, subject_id, valid_from, lag(id) OVER w AS a, lag(valid_from) OVER w + INTERVAL 6 HOURS AS a_end FROM facts WINDOW w AS (PARTITION BY subject_id ORDER BY valid_from, id))", body="SELECT a, b, subject_id FROM p WHERE a_end > valid_from")),
    "interval_overlap_pairs": (interval_overlap_pairs, with_sql(FACTS_SQL, body="SELECT a.id AS a, b.id AS b, b.subject_id FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND (a.valid_from, a.id) < (b.valid_from, b.id) AND b.valid_from < a.valid_from + INTERVAL 6 HOURS")),
    "window_closeout": (window_closeout, with_sql(FACTS_SQL, body=f"SELECT id, valid_to, CASE WHEN expired_at IS NULL AND valid_to < TIMESTAMP '{NOW}' THEN valid_to ELSE expired_at END AS expired_at FROM facts")),
    "bitemporal_latest": (bitemporal_latest, with_sql(FACTS_SQL, body=f"SELECT {', '.join(COLUMNS)} FROM facts QUALIFY row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from DESC, id DESC) = 1")),
    "top3_latest_facts": (top3_latest_facts, with_sql(FACTS_SQL, body="SELECT id, subject_id, recorded_at FROM facts QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, id DESC) <= 3")),
    "prior_episodes_for_source": (prior_episodes_for_source, with_sql(EPISODES_SQL, body="SELECT id, source_id, coalesce(array_to_string(list(id) OVER (PARTITION BY source_id ORDER BY id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), ','), '') AS prior FROM episodes")),
    "ghost_episodes": (ghost_episodes, with_sql(EPISODES_SQL, FACTS_SQL, body="SELECT id, group_id FROM episodes e WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.source_episode_id = e.id)")),
    "episodes_as_of": (episodes_as_of, with_sql(EPISODES_SQL, body="SELECT id, group_id, timestamp FROM episodes WHERE timestamp <= TIMESTAMP '2024-01-20 00:00:00'")),
    "episodes_since": (episodes_since, with_sql(EPISODES_SQL, body="SELECT group_id, count(*) AS n FROM episodes WHERE timestamp > TIMESTAMP '2024-01-20 00:00:00' GROUP BY group_id")),
    "world_time_audit": (world_time_audit, with_sql(FACTS_SQL, EPISODES_SQL, body="SELECT predicate, count(*) AS n, count(DISTINCT CAST(valid_from AS DATE)) AS days, CAST(sum(CASE WHEN CAST(valid_from AS DATE) < CAST(timestamp AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS back, CAST(sum(CASE WHEN CAST(valid_from AS DATE) > CAST(timestamp AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS forward, CAST(sum(CASE WHEN CAST(valid_from AS DATE) = CAST(timestamp AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS same FROM facts f JOIN episodes e ON f.source_episode_id = e.id GROUP BY predicate")),
    "event_windows": (event_windows, with_sql(FACTS_SQL, body="SELECT time_bucket(INTERVAL 6 HOURS, valid_from, TIMESTAMP '2024-01-01 00:00:00') AS start, predicate, count(*) AS n FROM facts GROUP BY 1, 2")),
    "supersession_candidates": (supersession_candidates, with_sql(FACTS_SQL, f"s AS (SELECT group_id, CAST(sum(CASE WHEN expired_at IS NULL AND valid_to < TIMESTAMP '{NOW}' THEN 1 ELSE 0 END) AS BIGINT) AS candidates, CAST(sum(CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS live FROM facts GROUP BY group_id)", body="SELECT group_id, candidates, live, CASE WHEN candidates > 0 AND live >= 20 AND candidates / live > 0.25 THEN 'Blocked' ELSE 'Allowed' END AS decision FROM s")),
}
