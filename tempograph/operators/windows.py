"""Running sums and exact ranks of groups of any size: no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: list[str], order: str, weight: Column, out: str, rows: int = 100_000) -> DataFrame:
    """Each row with the sum of a weight up to itself, inside its key, by a numeric column.

    The column's range is cut into so many parts that one holds about ``rows``
    rows of an even spread.  Parts are summed first; that small table is summed
    up in order, and a row adds what its own part has before it.  Null places
    come first.
    """
    span = df.agg(F.count("*").alias("n"), F.min(order).alias("low"), F.max(order).alias("high")).first()
    parts = max(1, -(-span["n"] // rows))
    width = max(1.0, ((span["high"] or 0) - (span["low"] or 0) + 1) / parts)
    part = F.coalesce(F.floor((F.col(order) - F.lit(span["low"] or 0)) / F.lit(width)), F.lit(-1))
    dealt = df.withColumn("_part", part).withColumn("_w", weight)
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.withColumn("_inside", F.sum("_w").over(inside)).join(offsets, [*keys, "_part"])
    return joined.withColumn(out, F.col("_before") + F.col("_inside")).drop("_part", "_w", "_inside", "_before")


def values_at(df: DataFrame, key: str, value: str, places: dict[str, Column], cells: int = 256) -> DataFrame:
    """One row per key with the values at places (from 0) of its sorted values; places are written over the number ``n``.

    Approximate quantiles cut each key's values into cells, which are counted
    exactly; only the cells that hold a wanted place are sorted, and one whose
    values are all equal is not even read again.
    """
    marks = F.percentile_approx(value, F.array(*[F.lit(i / cells) for i in range(1, cells)]), F.lit(10_000))
    cuts = df.groupBy(key).agg(F.count(value).alias("n"), marks.alias("_cuts"))
    dealt = df.filter(F.col(value).isNotNull()).join(F.broadcast(cuts), key) if cuts.limit(100_000).count() < 100_000 else df.filter(F.col(value).isNotNull()).join(cuts, key)
    v = F.col(value)
    dealt = dealt.select(key, value, "n", F.size(F.filter("_cuts", lambda c: c < v)).alias("_cell"))
    sized = dealt.groupBy(key, "n", "_cell").agg(F.count("*").alias("_size"), F.min(value).alias("_low"), F.max(value).alias("_high"))
    order = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("_before", F.coalesce(F.sum("_size").over(order), F.lit(0)))
    wanted = sized.withColumn("_place", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("at")) for name, place in places.items()])))
    wanted = wanted.select(key, "_cell", "_low", "_high", F.col("_place.name").alias("_name"), (F.col("_place.at") - F.col("_before")).alias("_at"), "_size").filter("_at >= 0 and _at < _size")
    settled = wanted.filter("_low = _high").select(key, "_name", F.col("_low").alias("_value"))
    open_ = wanted.filter("_low <> _high").select(key, "_cell", "_name", "_at")
    inside = dealt.join(open_.select(key, "_cell").distinct(), [key, "_cell"], "left_semi")
    ranked = inside.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_cell").orderBy(value)).cast("long") - 1)
    sought = ranked.join(open_, [key, "_cell", "_at"]).select(key, "_name", F.col(value).alias("_value"))
    return settled.union(sought).groupBy(key).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in places])
