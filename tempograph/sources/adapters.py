"""The knowledge-graph tables as views of the star-schema test data, in Spark and, as CTEs, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as episodes, one an hour."""
    return raw(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id as int), 0, 0)").alias("timestamp"),
        F.col("source").alias("source_id"),
        F.col("lang").alias("group_id"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as literal facts; a later event of the same user and type ends the one before."""
    ordered = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return raw(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("subject_id"),
        F.col("event_type").alias("predicate"),
        F.floor(F.col("value") / 10).cast("string").alias("object_value"),
        F.concat(F.lit("g"), (F.col("user_id") % 4).cast("string")).alias("group_id"),
        F.col("ts").alias("valid_from"),
        F.lead("ts").over(ordered).alias("valid_to"),
        F.col("ts").alias("recorded_at"),
        F.when(F.col("event_id") % 11 == 0, F.expr("ts + interval 1 day")).alias("expired_at"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        F.floor(F.col("event_id") / 5).alias("source_episode_id"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts between parts and suppliers; returned ones are expired."""
    return raw(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("subject_id"),
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("object_id"),
        F.lit("supplied_by").alias("predicate"),
        F.col("l_orderkey").alias("episode_id"),
        F.col("l_shipdate").alias("valid_from"),
        (F.col("l_returnflag") != "R").alias("active"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as entities of ten types in four namespaces."""
    return raw(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").alias("entity_type_id"),
        F.concat(F.lit("g"), (F.col("label") % 4).cast("string")).alias("group_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as named entities."""
    return raw(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("group_id"), F.col("p_type").alias("type_name")
    )


EPISODES_SQL = "episodes AS (SELECT doc_id AS id, coalesce(text, '') AS content, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id AS INTEGER)) AS timestamp, source AS source_id, lang AS group_id FROM documents)"
FACTS_SQL = "facts AS (SELECT event_id AS id, 'u:' || user_id AS subject_id, event_type AS predicate, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS object_value, 'g' || (user_id % 4) AS group_id, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to, ts AS recorded_at, CASE WHEN event_id % 11 = 0 THEN ts + INTERVAL 1 DAY END AS expired_at, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, event_id // 5 AS source_episode_id FROM events)"
EDGES_SQL = "edges AS (SELECT 'p:' || l_partkey AS subject_id, 's:' || l_suppkey AS object_id, 'supplied_by' AS predicate, l_orderkey AS episode_id, l_shipdate AS valid_from, l_returnflag <> 'R' AS active FROM lineitem)"
VECTORS_SQL = "vectors AS (SELECT vec_id AS id, label AS entity_type_id, 'g' || (label % 4) AS group_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
NAMES_SQL = "names AS (SELECT p_partkey AS id, p_name AS name, p_brand AS group_id, p_type AS type_name FROM part)"


def with_sql(*ctes: str, body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body
