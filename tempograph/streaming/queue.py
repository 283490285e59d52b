"""The ingestion queue: admission, rate, checkpoints, events, triggers.

The same expressions serve a batch and, inside ``foreachBatch``, each batch of
a stream; ``pump`` is the stream itself.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("done", "failed", "cancelled")


def admitted(items: DataFrame, tick: Column, capacity: int) -> DataFrame:
    """Items with ``admission``: of those that come in one tick as many as the queue holds, the others find it full."""
    order = Window.partitionBy("_tick").orderBy("id")
    placed = items.withColumn("_tick", tick).withColumn("_k", F.row_number().over(order))
    return placed.withColumn("admission", F.when(F.col("_k") <= capacity, "accepted").otherwise("full")).drop("_tick", "_k")


def progress(outcomes: DataFrame) -> DataFrame:
    """(batch_id, done, failed, total, status) of outcomes (batch_id, outcome, total)."""
    counted = outcomes.groupBy("batch_id").agg(F.count_if(F.col("outcome") == "done").alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"), F.max("total").alias("total"))
    over = (F.col("total") > 0) & (F.col("done") + F.col("failed") >= F.col("total"))
    status = F.when(~over, "pending").when(F.col("failed") == 0, "complete").when(F.col("done") > 0, "partial").otherwise("failed")
    return counted.withColumn("status", status)


def once(items: DataFrame, key: Column, order: str) -> DataFrame:
    """Items with ``outcome``: the first of a key is done, later ones are skipped."""
    first = Window.partitionBy("_key").orderBy(order)
    return items.withColumn("_key", key).withColumn("outcome", F.when(F.row_number().over(first) == 1, "done").otherwise("SkippedIdempotent")).drop("_key")


def cursors(items: DataFrame, op: Column, every: int = 10) -> DataFrame:
    """(op, id, n): a checkpoint at every so many-th item of a pass; the last one is where it resumes."""
    order = Window.partitionBy("op").orderBy("id")
    return items.withColumn("op", op).withColumn("n", F.row_number().over(order).cast("long")).filter(F.col("n") % every == 0).select("op", "id", "n")


def throttled(items: DataFrame, key: str, at: str, rate: float, capacity: float) -> DataFrame:
    """Items with ``allowed`` under a bucket of tokens per key that refills at ``rate`` a second up to ``capacity``.

    A bucket is a fold over its key's items in time, so a key is one group; its
    items come in order and only the fill is held.
    """
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, "id"], kind="stable")
        fill, last, out = capacity, None, []
        for t in rows[at]:
            if last is not None:
                fill = min(capacity, fill + (t - last).total_seconds() * rate)
            last = t
            out.append(fill >= 1.0)
            fill -= fill >= 1.0
        return rows.assign(allowed=out)

    return items.groupBy(key).applyInPandas(fold, f"{kind}, allowed boolean")


def due(low: Column, high: Column, every: str) -> Column:
    """The ticks of a schedule between two instants, both included."""
    return F.sequence(low, high, F.expr(f"interval {every}"))


def emitted(events: DataFrame, commits: DataFrame) -> DataFrame:
    """Events (episode_id, seq, ...) of committed episodes, in the order of commits; others were never sent."""
    return events.join(commits.select("episode_id", "version"), "episode_id").orderBy("version", "seq")


def cancelled(state: Column) -> Column:
    """What asking to cancel an item comes to."""
    return F.when(state.isin(*TERMINAL), F.concat(F.lit("already "), state)).when(state == "pending", "cancelled").otherwise("too late")


def out_of_order(facts: DataFrame, key: str, arrival: str, time: str) -> DataFrame:
    """Facts with ``late``: their world time lies before that of one of their key that came earlier; none is dropped."""
    before = Window.partitionBy(key).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("late", F.coalesce(F.col(time) < F.max(time).over(before), F.lit(False)))


def triggers(episodes: DataFrame, passes: DataFrame, minimum: int) -> DataFrame:
    """(group_id, last_pass, since, due): namespaces with enough new episodes since their last pass, none of which is running."""
    last = passes.groupBy("group_id").agg(F.max("ended_at").alias("last_pass"), F.max(F.col("ended_at").isNull().cast("int")).alias("_running"))
    both = episodes.join(last, "group_id", "left")
    fresh = both.groupBy("group_id", "last_pass").agg(F.count_if(F.col("last_pass").isNull() | (F.col("timestamp") > F.col("last_pass"))).alias("since"), F.max(F.coalesce("_running", F.lit(0))).alias("_running"))
    return fresh.select("group_id", "last_pass", "since", ((F.col("since") >= minimum) & (F.col("_running") == 0)).alias("due"))


def pump(stream: DataFrame, phases: list[Callable[[DataFrame, int], None]], checkpoint: str, listen: Callable[[str, int], None] | None = None):
    """Run each batch of a stream through phases in order; ``listen`` hears of a phase only after it is committed."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        for phase in phases:
            phase(held, number)
            if listen:
                listen(phase.__name__, number)
        held.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

