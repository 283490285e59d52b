"""Edits that can be taken back: each gives the rows after it and the log rows that undo it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ENDS = ("subject_id", "object_id")

#: What takes back each kind of mutation.
UNDO = {"merge": "unmerge", "archive": "restore", "supersede": "reset", "rename": "rename", "retype": "retype", "delete": "restore"}


def touching(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Facts with an end among ``ids`` (a column ``id``): one equi-join per end."""
    by_end = [facts.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*facts.columns) for end in ENDS]
    return reduce(DataFrame.union, by_end).dropDuplicates(["id"])


def refusals(merges: DataFrame) -> DataFrame:
    """Merges (id, loser, keeper, undone) with ``refused``: a later merge that still stands names either party."""
    standing = merges.filter("not undone")
    parties = standing.select("id", F.explode(F.array("loser", "keeper")).alias("party")).groupBy("party").agg(F.max("id").alias("last"))
    out = merges
    for side in ("loser", "keeper"):
        out = out.join(parties.select(F.col("party").alias(side), F.col("last").alias(f"_{side}")), side, "left")
    later = F.greatest(F.coalesce("_loser", F.lit(-1)), F.coalesce("_keeper", F.lit(-1))) > F.col("id")
    return out.withColumn("refused", later & ~F.col("undone")).drop("_loser", "_keeper")


def rename(facts: DataFrame, entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts after entities took new ids, the log of what they were, and the renames refused as the new id exists."""
    refused = names.join(entities.select(F.col("id").alias("new")), "new", "left_semi").select("old", "new")
    taken = names.join(refused, ["old", "new"], "left_anti").select("old", "new")
    log = touching(facts, taken.select(F.col("old").alias("id"))).select(F.col("id").alias("fact_id"), *ENDS)
    after = facts
    for end in ENDS:
        after = after.join(taken.select(F.col("old").alias(end), F.col("new").alias(f"_{end}")), end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return after.select(*facts.columns), log, refused


def restore_ends(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Facts with the ends that the log holds."""
    old = log.select(F.col("fact_id").alias("id"), *[F.col(e).alias(f"_{e}") for e in ENDS], F.lit(True).alias("_hit"))
    out = facts.join(old, "id", "left")
    for end in ENDS:
        out = out.withColumn(end, F.when(F.col("_hit"), F.col(f"_{end}")).otherwise(F.col(end)))
    return out.select(*facts.columns)


def delete(facts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts left after entities went, those archived with them, and the neighbours that nothing live supports any more."""
    archived = touching(facts, gone)
    left = facts.join(archived.select("id"), "id", "left_anti")
    ends = lambda f: f.select(F.explode(F.array(*ENDS)).alias("id")).distinct()
    live = left.filter("active") if "active" in left.columns else left.filter("expired_at is null")
    bare = ends(archived).join(gone, "id", "left_anti").join(ends(live), "id", "left_anti")
    return left, archived, bare


def restored(archived: DataFrame, live: DataFrame, wanted: DataFrame) -> DataFrame:
    """What asking for facts (a column ``id``) back comes to: restored, only the archive's copy dropped, or missing."""
    a = archived.select("id", F.lit(True).alias("_archived")).distinct()
    b = live.select("id", F.lit(True).alias("_live")).distinct()
    both = wanted.join(a, "id", "left").join(b, "id", "left")
    outcome = F.when(F.col("_archived").isNull(), "missing").when(F.col("_live"), "copy dropped").otherwise("restored")
    return both.select("id", outcome.alias("outcome"))


def reset(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Facts whose logged bound (id, before, bound) is taken back, unless the end has changed since (``stale``)."""
    both = facts.join(log.select("id", "before", "bound", F.lit(True).alias("_hit")), "id", "left")
    same = F.col("_hit") & F.col("valid_to").eqNullSafe(F.col("bound"))
    stale = F.coalesce(F.col("_hit") & ~F.col("valid_to").eqNullSafe(F.col("bound")), F.lit(False))
    return both.withColumn("stale", stale).withColumn("valid_to", F.when(same, F.col("before")).otherwise(F.col("valid_to"))).drop("_hit", "before", "bound")


def undo_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in UNDO.items()], F.lit("unknown"))


def split(facts: DataFrame, moved: DataFrame, keeper: str, new: str) -> DataFrame:
    """Facts of a keeper that a wrong merge gave it, listed by id, go to the entity split off."""
    hit = facts.join(moved.select("id", F.lit(True).alias("_hit")), "id", "left")
    for end in ENDS:
        hit = hit.withColumn(end, F.when(F.col("_hit") & (F.col(end) == keeper), new).otherwise(F.col(end)))
    return hit.select(*facts.columns)


def reopened(keys: DataFrame, edited: DataFrame) -> DataFrame:
    """Idempotency keys (entity_id, ...) that an edit leaves, so that passes see the edited entities again."""
    return keys.join(edited.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")


def loops_after(facts: DataFrame, merged: DataFrame) -> DataFrame:
    """Live facts between a loser and its keeper, either way, or of a keeper with itself: what a merge turns into loops."""
    own = merged.select("loser", "keeper").union(merged.select("keeper", "loser")).union(merged.select("keeper", "keeper")).distinct().toDF(*ENDS)
    return facts.join(own, list(ENDS), "left_semi")


def covered(cliques: DataFrame) -> DataFrame:
    """Of cliques (component, members, weight) of one component a cover without overlap: larger first, then heavier, then by least member.

    A component is bounded (see ``resolve.merge_groups``), so its cliques are one small array.
    """
    order = Window.partitionBy("component").orderBy(F.size("members").desc(), F.col("weight").desc(), F.array_min("members"))
    ranked = cliques.withColumn("k", F.row_number().over(order))
    listed = ranked.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("k", "members"))).alias("all"))
    nothing = F.array().cast(cliques.schema["members"].dataType)
    state = F.struct(nothing.alias("used"), F.array().cast(f"array<{cliques.schema['members'].dataType.simpleString()}>").alias("chosen"))

    def take(s: Column, c: Column) -> Column:
        free = F.size(F.array_intersect(s.used, c.members)) == 0
        return F.when(free, F.struct(F.concat(s.used, c.members).alias("used"), F.concat(s.chosen, F.array(c.members)).alias("chosen"))).otherwise(s)

    return listed.select("component", F.explode(F.aggregate("all", state, take).chosen).alias("members"))
