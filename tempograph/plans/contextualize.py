"""The recall plan: fuse, normalise, expand, boost, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.config import DEFAULT, Config
from tempograph.functions import scoring
from tempograph.functions.temporal import latest
from tempograph.operators import search
from tempograph.operators.graph import kept


def contextualize(docs: DataFrame, hits: DataFrame, vectors: DataFrame, query: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(id, score): the fused seeds with their boosts, and what lies beside them at half their score.

    ``hits`` are the text search's (id, score).  The seeds, at most ``top_k``
    rows, are written before they are used, so that both searches run once.
    Episodes of the same source and namespace are neighbours, as many of each
    seed as the fan-out allows.
    """
    seeds = search.hybrid(hits, vectors, query, config.top_k, weights=(config.bm25_weight, config.vector_weight), rrf_k=config.rrf_k)
    seeds = kept(scoring.min_max(kept(seeds)))
    return spread(seeds, kept(neighbours(seeds.select("id"), docs, config.fan_out_cap)), config)


def neighbours(seeds: DataFrame, docs: DataFrame, cap: int) -> DataFrame:
    thin = docs.select("id", "source_id", "group_id")
    own = thin.join(F.broadcast(seeds), "id").select(F.col("id").alias("seed"), "source_id", "group_id")
    near = thin.join(F.broadcast(own), ["source_id", "group_id"]).filter("id <> seed").select("seed", "id").distinct()
    return latest(near, ["seed"], [F.col("id")], cap)


def spread(seeds: DataFrame, near: DataFrame, config: Config) -> DataFrame:
    degree = near.groupBy("seed").agg(F.count("*").alias("degree"))
    bonus = scoring.saturating(F.coalesce("degree", F.lit(0)), config.degree_weight, config.degree_saturation)
    boosted = seeds.join(degree, seeds.id == degree.seed, "left").select("id", F.least(F.col("score") + bonus, F.lit(1.0)).alias("score"))
    beside = near.join(boosted.withColumnRenamed("id", "seed"), "seed").select("id", (F.col("score") * config.neighbour_decay).alias("score"))
    out = boosted.union(beside).groupBy("id").agg(F.round(F.max("score"), 6).alias("score"))
    return out.filter(F.col("score") >= config.floor) if config.floor > 0 else out
