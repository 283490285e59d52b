"""Two-clock predicates: world time is half open, an open end is null, expired rows are history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def far() -> Column:
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")


def instant(t: datetime | str) -> Column:
    return F.lit(str(t)).cast("timestamp_ntz")


def valid_at(t: Column) -> Column:
    """In force at t in world time and not expired; when it was recorded does not matter."""
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)) & F.col("expired_at").isNull()


def known_at(s: Column) -> Column:
    """An extra: recorded by s and not expired then."""
    return (F.col("recorded_at") <= s) & (F.col("expired_at").isNull() | (F.col("expired_at") > s))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < F.coalesce(b_end, far())) & (b_start < F.coalesce(a_end, far()))


def facts_at(facts: DataFrame, t: Column) -> DataFrame:
    return facts.filter(valid_at(t))


def history(facts: DataFrame) -> DataFrame:
    """Every version of each subject with its place and the start of the next one."""
    order = Window.partitionBy("subject_id").orderBy("valid_from", "recorded_at", "id")
    return facts.withColumn("version", F.row_number().over(order).cast("long")).withColumn("next_from", F.lead("valid_from").over(order))


def facts_at_times(facts: DataFrame, times: DataFrame, days: int = 1) -> DataFrame:
    """Facts in force at each of many times (a column ``t``), as an equi-join.

    Each fact is put into the buckets of ``days`` days that it spans, no
    further than the last time asked for, and meets the times of its bucket.
    """
    width = days * 86_400
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    span = times.agg(F.min("t").alias("low"), F.max("t").alias("high"))
    asked = times.withColumn("bucket", F.floor(seconds(F.col("t")) / width))
    live = facts.filter("expired_at is null").crossJoin(F.broadcast(span))  # one row
    live = live.filter((F.col("valid_from") <= F.col("high")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("low"))))
    first = F.floor(seconds(F.greatest("valid_from", "low")) / width)
    last = F.floor(seconds(F.least(F.coalesce("valid_to", "high"), F.col("high"))) / width)
    put = live.withColumn("bucket", F.explode(F.sequence(first, last))).drop("low", "high")
    return put.join(asked, "bucket").filter((F.col("valid_from") <= F.col("t")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("t")))).drop("bucket")


def overlapping_pairs(facts: DataFrame, keys: list[str], days: int = 1) -> DataFrame:
    """All pairs of facts of the same key whose intervals overlap: the later one's row, the earlier one as ``other``.

    As an equi-join: the earlier fact lies in every bucket of ``days`` days
    that it spans, no further than the last start, the later one only in that
    of its start, so each pair meets once.  Facts without a key meet none.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / days)
    earlier = facts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("id", "valid_from", "valid_to").alias("other"))
    start, end = F.col("other.valid_from"), F.coalesce("other.valid_to", far())
    earlier = earlier.crossJoin(F.broadcast(facts.agg(F.max("valid_from").alias("_high")))).filter(end > start)  # one row
    earlier = earlier.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(F.least(end, "_high"))))).drop("_high")
    later = facts.withColumn("_at", bucket(F.col("valid_from")))
    first = (start < F.col("valid_from")) | ((start == F.col("valid_from")) & (F.col("other.id") < F.col("id")))
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_at") == F.col("_bucket")]
    both = later.join(earlier, same).filter(first & overlaps(start, F.col("other.valid_to"), F.col("valid_from"), F.col("valid_to")))
    return both.drop("_at", "_bucket", *[f"_{k}" for k in keys])


def overlapping_neighbours(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours in time of the same key whose intervals overlap (each with the one before)."""
    order = Window.partitionBy(*keys).orderBy("valid_from", "id")
    before = facts.withColumn("other", F.lag(F.struct("id", "valid_from", "valid_to")).over(order))
    return before.filter(F.col("other").isNotNull() & overlaps(F.col("other.valid_from"), F.col("other.valid_to"), F.col("valid_from"), F.col("valid_to")))


def close_out(facts: DataFrame, now: Column) -> DataFrame:
    """Facts whose window has passed are expired at its end."""
    due = F.col("expired_at").isNull() & F.col("valid_to").isNotNull() & (F.col("valid_to") < now)
    return facts.withColumn("expired_at", F.when(due, F.col("valid_to")).otherwise(F.col("expired_at")))


def latest(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")
