"""Ingestion as a stream: idempotent facts, batch states, event windows.

Nothing is dropped as late unless a watermark is asked for; world time comes
from the record, not from its arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempograph.functions.text import fact_hash

BATCH_STATE = "batch_id string, done long, failed long, total long, status string"


def read_events(spark: SparkSession, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream; ``per_trigger`` is the back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def deduplicated(facts: DataFrame, watermark: str | None = None, time: str = "recorded_at") -> DataFrame:
    """The first arrival of each triple, whose object is an entity or a value; with a watermark the state stays bounded."""
    given = [F.col(c) for c in ("object_id", "object_value") if c in facts.columns]
    keyed = facts.withColumn("content_hash", fact_hash(F.col("subject_id"), F.col("predicate"), F.coalesce(*given)))
    if watermark is None:
        return keyed.dropDuplicates(["content_hash"])
    return keyed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["content_hash"])


def _track(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    done, failed, total = state.get if state.exists else (0, 0, 0)
    for part in rows:
        done += int((part["outcome"] == "done").sum())
        failed += int((part["outcome"] == "failed").sum())
        total = max(total, int(part["total"].max()))
    state.update((done, failed, total))
    over = total > 0 and done + failed >= total
    status = "pending" if not over else "complete" if not failed else "partial" if done else "failed"
    yield pd.DataFrame({"batch_id": [key[0]], "done": [done], "failed": [failed], "total": [total], "status": [status]})


def batch_states(outcomes: DataFrame) -> DataFrame:
    """(batch_id, done, failed, total, status) as outcomes (batch_id, outcome, total) arrive."""
    return outcomes.groupBy("batch_id").applyInPandasWithState(_track, BATCH_STATE, "done long, failed long, total long", "update", GroupStateTimeout.NoTimeout)


def interrupted(states: DataFrame) -> DataFrame:
    """Batches that a shutdown leaves unfinished."""
    return states.filter("status = 'pending'")


def windows(facts: DataFrame, size: str, slide: str | None = None, watermark: str | None = None, time: str = "valid_from") -> DataFrame:
    """Counts by predicate and window, an extra."""
    stamped = facts.withColumn("_t", F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark("_t", watermark) if watermark else stamped
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return stamped.groupBy(w.alias("window"), "predicate").agg(F.count("*").alias("n"))


def write(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Exactly once into Parquet; a restart resumes at the checkpoint."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
