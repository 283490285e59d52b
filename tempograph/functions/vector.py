"""Vector functions; products are added in order, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def scored(vectors: DataFrame, query: DataFrame, digits: int = 6) -> DataFrame:
    """Cosine of every vector with one query vector (a row with ``query_embedding``)."""
    near = vectors.crossJoin(F.broadcast(query)).withColumn("score", F.round(cosine(F.col("embedding"), F.col("query_embedding")), digits))
    return near.filter("score is not null").drop("query_embedding")


def top_k(vectors: DataFrame, query: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """The k nearest to one query vector; ties by id."""
    return scored(vectors, query, digits).orderBy(F.col("score").desc(), "id").limit(k)


def nearest_each(vectors: DataFrame, key: str, pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each key."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "other_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
