"""Writes as functions from tables to tables, with a log that can be played back.

A table is a set of rows; a write gives the rows that it leaves.  Nothing is
deleted from history: facts are expired, merges and archives log what was
there before, and undoing a mutation puts that back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRIPLE = ["subject_id", "predicate", "object_value"]


def accepted(facts: DataFrame, key: list[str] = TRIPLE) -> DataFrame:
    """Expired facts, and of active ones that say the same the first."""
    order = Window.partitionBy(*key, F.col("expired_at").isNull()).orderBy("id")
    return facts.withColumn("_k", F.row_number().over(order)).filter(F.col("expired_at").isNotNull() | (F.col("_k") == 1)).drop("_k")


def insert_outcome(existing: DataFrame, fresh: DataFrame, key: list[str] = TRIPLE) -> DataFrame:
    """New rows with ``outcome``: a duplicate of an active row or of an earlier new one, a self-loop, or inserted."""
    old = existing.filter("expired_at is null").select(*key).distinct().withColumn("_old", F.lit(True))
    placed = fresh.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).join(old, key, "left")
    loop = F.col("subject_id") == F.col("object_id") if "object_id" in fresh.columns else F.lit(False)
    outcome = F.when(loop, "self-loop").when(F.col("_old").isNotNull() | (F.col("_k") > 1), "duplicate").otherwise("inserted")
    return placed.withColumn("outcome", outcome).drop("_k", "_old")


def upserted(rows: DataFrame, key: list[str], order: str, last: list[str], first: list[str]) -> DataFrame:
    """One row per key: the latest values of some columns, the earliest of others."""
    return rows.groupBy(*key).agg(*[F.max_by(c, order).alias(c) for c in last], *[F.min_by(c, order).alias(c) for c in first])


def invalidate(facts: DataFrame, which: Column, at: Column) -> DataFrame:
    """Active facts are expired and marked as contradicted."""
    hit = which & F.col("expired_at").isNull()
    before = F.col("invalid_at") if "invalid_at" in facts.columns else F.lit(None).cast("timestamp_ntz")
    return facts.withColumn("invalid_at", F.when(hit, at).otherwise(before)).withColumn("expired_at", F.when(hit, at).otherwise(F.col("expired_at")))


def bound(facts: DataFrame, which: Column, end: Column) -> DataFrame:
    """The end of world time is set, unless it would lie before the start (``rejected``)."""
    fits = F.col("valid_from") <= end
    return facts.withColumn("rejected", which & ~fits).withColumn("valid_to", F.when(which & fits, end).otherwise(F.col("valid_to")))


def without(facts: DataFrame, which: Column) -> DataFrame:
    return facts.filter(~which)


def archived(facts: DataFrame, before: Column) -> DataFrame:
    """Facts with ``archive``: expired before a time, and their subject keeps a live fact."""
    live = facts.groupBy("subject_id").agg(F.sum(F.col("expired_at").isNull().cast("long")).alias("live"))
    return facts.join(live, "subject_id").withColumn("archive", F.coalesce(F.col("expired_at") < before, F.lit(False)) & (F.col("live") > 0))


def forgettable(mentions: DataFrame, source: str) -> DataFrame:
    """(entity_id): entities mentioned by a source and by no other."""
    own = mentions.groupBy("entity_id").agg(F.max((F.col("source_id") == source).cast("int")).alias("in_"), F.max((F.col("source_id") != source).cast("int")).alias("out"))
    return own.filter("in_ = 1 and coalesce(out, 0) = 0").select("entity_id")


def merge(facts: DataFrame, merged: DataFrame, log_id: int, at: Column) -> tuple[DataFrame, DataFrame]:
    """Facts after losers became keepers, and the log rows that undo it."""
    from .resolve import repoint

    # one equi-join per end, not one join on either
    s = merged.select(F.col("loser").alias("_l")).distinct()
    ids = facts.join(s, facts.subject_id == s._l, "left_semi").select("id").union(facts.join(s, facts.object_id == s._l, "left_semi").select("id"))
    touched = facts.join(ids.distinct(), "id", "left_semi")
    log = touched.select(F.lit(log_id).alias("log_id"), F.lit("merge").alias("kind"), F.to_json(F.struct("id", "subject_id", "object_id", F.col("expired_at").cast("string").alias("expired_at"))).alias("pre_state"))
    after = repoint(facts, merged)
    return after.withColumn("expired_at", F.when(F.col("loops") & F.col("expired_at").isNull(), at).otherwise(F.col("expired_at"))).drop("loops"), log


def undo(facts: DataFrame, log: DataFrame, log_id: int) -> DataFrame:
    """Facts with what one log entry holds put back."""
    state = F.from_json("pre_state", "id bigint, subject_id string, object_id string, expired_at string")
    old = log.filter(F.col("log_id") == log_id).select(state.alias("s")).select(
        F.col("s.id").alias("_id"), F.col("s.subject_id").alias("_s"), F.col("s.object_id").alias("_o"), F.col("s.expired_at").cast("timestamp_ntz").alias("_e")
    )
    hit = F.col("_id").isNotNull()
    return (
        facts.join(old, facts.id == old._id, "left")
        .withColumn("subject_id", F.when(hit, F.col("_s")).otherwise(F.col("subject_id")))
        .withColumn("object_id", F.when(hit, F.col("_o")).otherwise(F.col("object_id")))
        .withColumn("expired_at", F.when(hit, F.col("_e")).otherwise(F.col("expired_at")))
        .drop("_id", "_s", "_o", "_e")
    )


def log_view(log: DataFrame, kind: str | None = None, undone: bool = False) -> DataFrame:
    """Log rows, the latest first; undone ones only if asked for."""
    out = log if kind is None else log.filter(F.col("kind") == kind)
    return (out if undone else out.filter("undone_at is null")).orderBy(F.col("created_at").desc(), F.col("id").desc())


def blocked(policy: Column) -> Column:
    """Namespaces that only append refuse supersession and forgetting."""
    return policy == "AppendOnly"


def patched(metadata: Column, patch: dict[str, str | Column]) -> Column:
    """Top-level keys overwritten; other keys stay."""
    whole = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,string>")
    new = F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in patch.items() for x in kv])
    return F.to_json(F.map_concat(F.map_filter(whole, lambda k, v: ~k.isin(*patch)), new))
