"""The queue's expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.sources.adapters import EPISODES_SQL, FACTS_SQL, episodes, facts, raw, with_sql
from tempograph.streaming import queue


def queue_admission(spark, sf):
    """Events of an hour against a queue that holds 12."""
    e = raw(spark, sf, "events").select(F.col("event_id").alias("id"), "ts")
    return queue.admitted(e, F.date_trunc("hour", F.col("ts")), 12).select("id", "admission")


def two_phase(spark, sf):
    """Each episode's first phase and, for longer ones, the deferred second, in order."""
    e = episodes(spark, sf).select("id", F.octet_length("content").alias("n"))
    phases = F.when(F.col("n") > 400, F.array(F.lit("phase1"), F.lit("deferred"))).otherwise(F.array(F.lit("phase1")))
    return e.select("id", F.posexplode(phases).alias("seq", "phase")).select("id", F.col("seq").cast("long").alias("seq"), "phase")


def op_checkpoints(spark, sf):
    return queue.cursors(episodes(spark, sf).select("id", "source_id"), F.col("source_id"))


def resume_cursors(spark, sf):
    return op_checkpoints(spark, sf).groupBy("op").agg(F.max("id").alias("id"))


def outcomes(spark, sf):
    e = raw(spark, sf, "events").withColumn("batch_id", F.floor(F.col("event_id") / 6))
    kind = F.when(F.col("event_id") % 13 == 0, "failed").when(F.col("event_id") % 17 == 0, "running").otherwise("done")
    return e.select("batch_id", kind.alias("outcome"), F.lit(6).cast("long").alias("total"))


def batch_progress(spark, sf):
    return queue.progress(outcomes(spark, sf))


def interrupted_batches(spark, sf):
    """Batches that a shutdown leaves unfinished."""
    return queue.progress(outcomes(spark, sf)).filter("status = 'pending'").select("batch_id", (F.col("total") - F.col("done") - F.col("failed")).alias("missing"))


def rate_limited(spark, sf):
    """Events that a bucket of three tokens per user, one a day, lets through."""
    e = raw(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "ts")
    return queue.throttled(e, "user_id", "ts", 1 / 86_400, 3.0).groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


def exactly_once(spark, sf):
    e = raw(spark, sf, "events")
    key = F.sha2(F.concat_ws("␟", F.col("user_id").cast("string"), F.col("event_type")), 256)
    return queue.once(e, key, "event_id").select("event_id", "outcome")


def schedule_ticks(spark, sf):
    """When a pass every six hours is due over the events' time."""
    span = raw(spark, sf, "events").agg(F.date_trunc("day", F.min("ts")).cast("timestamp_ntz").alias("low"), F.max("ts").alias("high"))
    return span.select(F.explode(queue.due(F.col("low"), F.col("high"), "6 hours")).alias("tick"))


def committed_events(spark, sf):
    """Events of ingestion that were sent, for the episodes whose commit came through."""
    e = raw(spark, sf, "events").select(F.floor(F.col("event_id") / 5).alias("episode_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
    commits = episodes(spark, sf).filter("id % 3 <> 0").select(F.col("id").alias("episode_id"), (F.col("id") * 7 % 1000).alias("version"))
    return queue.emitted(e, commits).select("episode_id", "seq", "kind", "version")


def cancel_outcomes(spark, sf):
    states = F.array(*[F.lit(x) for x in ("pending", "phase1", "verified", "facts", "done", "failed", "cancelled")])
    return raw(spark, sf, "events").select("event_id", queue.cancelled(F.element_at(states, (F.col("event_id") % 7 + 1).cast("int"))).alias("outcome"))


def late_facts(spark, sf):
    """Facts that arrive in an order of their own: how many lie before one that came earlier, by user."""
    f = facts(spark, sf).withColumn("arrival", F.col("id") * 31 % 1009)
    f = f.withColumn("arrival", F.struct("arrival", "id"))
    return queue.out_of_order(f, "subject_id", "arrival", "valid_from").groupBy("subject_id").agg(F.count_if("late").alias("late"), F.count("*").alias("n"))


def trigger_inputs(spark, sf):
    """Namespaces due for a pass: twenty episodes since the last one, and none running."""
    e = episodes(spark, sf).select("group_id", "timestamp")
    day = lambda d: F.lit(f"2024-01-{d:02d} 00:00:00").cast("timestamp_ntz")
    passes = spark.createDataFrame([("en", 5), ("en", 2), ("de", 3), ("fr", None)], "group_id string, d int")
    passes = passes.select("group_id", F.when(F.col("d") == 5, day(5)).when(F.col("d") == 2, day(2)).when(F.col("d") == 3, day(3)).alias("ended_at"))
    return queue.triggers(e, passes, 20)


def saga_sequences(spark, sf):
    """Gaps in the numbers of each saga, were every ninth episode lost."""
    order = Window.partitionBy("source_id").orderBy("timestamp", "id")
    s = episodes(spark, sf).withColumn("n", F.row_number().over(order)).filter("id % 9 <> 4")
    gap = s.withColumn("before", F.lag("n").over(Window.partitionBy("source_id").orderBy("n"))).filter("n - before > 1")
    return gap.groupBy("source_id").agg(F.count("*").alias("gaps"), F.sum(F.col("n") - F.col("before") - 1).alias("missing"))


PROGRESS = "p AS (SELECT event_id // 6 AS batch_id, count(*) FILTER (WHERE event_id % 13 <> 0 AND event_id % 17 <> 0) AS done, count(*) FILTER (WHERE event_id % 13 = 0) AS failed, CAST(6 AS BIGINT) AS total FROM events GROUP BY 1), s AS (SELECT *, CASE WHEN done + failed < total THEN 'pending' WHEN failed = 0 THEN 'complete' WHEN done > 0 THEN 'partial' ELSE 'failed' END AS status FROM p)"
CURSORS = "c AS (SELECT source_id AS op, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS n FROM episodes)"

QUERIES = {
    "queue_admission": (queue_admission, "SELECT event_id AS id, CASE WHEN row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) <= 12 THEN 'accepted' ELSE 'full' END AS admission FROM events"),
    "two_phase": (two_phase, with_sql(EPISODES_SQL, body="SELECT id, CAST(0 AS BIGINT) AS seq, 'phase1' AS phase FROM episodes UNION ALL SELECT id, 1, 'deferred' FROM episodes WHERE strlen(content) > 400")),
    "op_checkpoints": (op_checkpoints, with_sql(EPISODES_SQL, CURSORS, body="SELECT op, id, n FROM c WHERE n % 10 = 0")),
    "resume_cursors": (resume_cursors, with_sql(EPISODES_SQL, CURSORS, body="SELECT op, max(id) AS id FROM c WHERE n % 10 = 0 GROUP BY op")),
    "batch_progress": (batch_progress, with_sql(PROGRESS, body="SELECT batch_id, done, failed, total, status FROM s")),
    "interrupted_batches": (interrupted_batches, with_sql(PROGRESS, body="SELECT batch_id, total - done - failed AS missing FROM s WHERE status = 'pending'")),
    "rate_limited": (rate_limited, None),
    "exactly_once": (exactly_once, "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1 THEN 'done' ELSE 'SkippedIdempotent' END AS outcome FROM events"),
    "schedule_ticks": (schedule_ticks, "SELECT unnest(generate_series(date_trunc('day', min(ts)), max(ts), INTERVAL 6 HOURS)) AS tick FROM events"),
    "committed_events": (committed_events, "SELECT event_id // 5 AS episode_id, event_id AS seq, event_type AS kind, (event_id // 5) * 7 % 1000 AS version FROM events WHERE (event_id // 5) % 3 <> 0 AND event_id // 5 IN (SELECT doc_id FROM documents)"),
    "cancel_outcomes": (cancel_outcomes, "SELECT event_id, ['cancelled', 'too late', 'too late', 'too late', 'already done', 'already failed', 'already cancelled'][event_id % 7 + 1] AS outcome FROM events"),
    "late_facts": (late_facts, with_sql(FACTS_SQL, "l AS (SELECT subject_id, valid_from < max(valid_from) OVER (PARTITION BY subject_id ORDER BY id * 31 % 1009, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM facts)", body="SELECT subject_id, count(*) FILTER (WHERE late) AS late, count(*) AS n FROM l GROUP BY subject_id")),
    "trigger_inputs": (trigger_inputs, with_sql(EPISODES_SQL, "p AS (SELECT * FROM (VALUES ('en', TIMESTAMP '2024-01-05 00:00:00', 0), ('de', TIMESTAMP '2024-01-03 00:00:00', 0), ('fr', NULL, 1)) t(group_id, last_pass, running))", "s AS (SELECT e.group_id, last_pass, count(*) FILTER (WHERE last_pass IS NULL OR timestamp > last_pass) AS since, max(coalesce(running, 0)) AS running FROM episodes e LEFT JOIN p ON p.group_id = e.group_id GROUP BY 1, 2)", body="SELECT group_id, last_pass, since, since >= 20 AND running = 0 AS due FROM s")),
    "saga_sequences": (saga_sequences, with_sql(EPISODES_SQL, "n AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY timestamp, id) AS n FROM episodes)", "g AS (SELECT source_id, n, lag(n) OVER (PARTITION BY source_id ORDER BY n) AS b FROM n WHERE id % 9 <> 4)", body="SELECT source_id, count(*) AS gaps, CAST(sum(n - b - 1) AS BIGINT) AS missing FROM g WHERE n - b > 1 GROUP BY source_id")),
}
