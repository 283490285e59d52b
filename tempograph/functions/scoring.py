"""Ranking arithmetic: fusion, boosts, intervals, metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(arm: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Places from 0; an arm is a bounded list, ordered by score and key."""
    return arm.withColumn("rank0", F.row_number().over(Window.orderBy(*order)) - 1).select(*keys, "rank0")


def rrf(arms: list[tuple[DataFrame, float]], keys: list[str], k: float) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank + 1) over arms of (keys, rank0)."""
    parts = [a.select(*keys, (F.lit(w) / (F.lit(float(k)) + F.col("rank0") + 1)).alias("part")) for a, w in arms]
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"))


def min_max(scored: DataFrame, column: str = "score") -> DataFrame:
    """Scores from 0 to 1; all equal is 1 for all."""
    span = scored.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    out = F.when(F.col("_high") == F.col("_low"), 1.0).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return scored.crossJoin(F.broadcast(span)).withColumn(column, out).drop("_low", "_high")


def saturating(count: Column, weight: float, saturation: int) -> Column:
    return F.lit(weight) * F.least(count / F.lit(float(saturation)), F.lit(1.0))


def recency(age_days: Column, weight: float, decay: float) -> Column:
    return F.lit(weight) * F.exp(-F.lit(decay) * F.greatest(age_days, F.lit(0.0)))


def noisy_or(a: Column, b: Column) -> Column:
    both = F.least(F.greatest(a + b - a * b, F.lit(0.0)), F.lit(1.0))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def confidence_floor(a: Column, b: Column) -> Column:
    """The lower of two, null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    empty = n == 0
    return F.when(empty, 1.0).otherwise(F.greatest(middle - half, F.lit(0.0))), F.when(empty, 1.0).otherwise(F.least(middle + half, F.lit(1.0)))


def f1(expected: Column, predicted: Column) -> tuple[Column, Column, Column, Column, Column, Column]:
    """True and false positives, false negatives, precision, recall and F1 of two sets; both empty is perfect."""
    tp = F.size(F.array_intersect(expected, predicted))
    fp = F.size(F.array_except(predicted, expected))
    fn = F.size(F.array_except(expected, predicted))
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.when(fn == 0, 1.0).otherwise(0.0))
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    return tp, fp, fn, precision, recall, F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def decide_bulk(candidates: Column, live: Column, minimum: int = 20, share: float = 0.25) -> Column:
    """Whether an expiry of many facts at once is let through."""
    return F.when((candidates > 0) & (live >= minimum) & (candidates / live > share), "Blocked").otherwise("Allowed")


def mcnemar_p(b: Column, c: Column) -> Column:
    """The exact two-sided chance of so uneven a split of b + c pairs, from the ratios of neighbouring binomial terms."""
    n, least = (b + c).cast("double"), F.least(b, c)
    state = F.struct((-n * F.log(F.lit(2.0))).alias("term"), F.exp(-n * F.log(F.lit(2.0))).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s.term + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (s.total + F.exp(term)).alias("total"))

    places = F.when(least > 0, F.sequence(F.lit(1).cast("bigint"), least)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(places, state, step, lambda s: s.total)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def fuzzy_counts(expected: Column, given: Column) -> tuple[Column, Column, Column]:
    """True positives over what is expected, false positives over what is given, false negatives: alike is one being part of the other."""
    alike = lambda x, y: F.contains(x, y) | F.contains(y, x)
    found = F.size(F.filter(expected, lambda x: F.exists(given, lambda y: alike(x, y))))
    extra = F.size(F.filter(given, lambda y: ~F.exists(expected, lambda x: alike(x, y))))
    return found.cast("long"), extra.cast("long"), (F.size(expected) - found).cast("long")
