"""Scans, pages, keyed reads, and what writes would make of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import text
from tempograph.operators import mutate
from tempograph.sources.adapters import EDGES_SQL, EPISODES_SQL, FACTS_SQL, NAMES_SQL, edges, episodes, facts, names, raw, vectors, with_sql


def scan_entities(spark, sf):
    types = raw(spark, sf, "nation").select(F.col("n_nationkey").alias("t"), F.col("n_name").alias("type_name"))
    own = raw(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("group_id"), F.col("c_nationkey").alias("t"))
    return own.join(F.broadcast(types), "t", "left").select("id", "group_id", F.coalesce("type_name", F.lit("Entity")).alias("label"))


def get_entity(spark, sf):
    return names(spark, sf).filter("id = 42").select("id", "name", "group_id")


def keyset_entities(spark, sf):
    after = F.struct(F.lit(100).cast("long"), F.lit("Brand#1"))
    return names(spark, sf).filter(F.struct("id", "group_id") > after).orderBy("id", "group_id").limit(50).select("id", "group_id")


def keyset_facts(spark, sf):
    page = facts(spark, sf).filter("id > 500").orderBy("id").limit(50)
    return page.select("id", F.concat_ws(" ", "subject_id", "predicate", "object_value").alias("text"))


def missing_embeddings(spark, sf):
    own = vectors(spark, sf).select(F.col("id").alias("vid"))
    return episodes(spark, sf).join(own, F.col("id") == F.col("vid"), "left_anti").select("id", "group_id")


def facts_by_key(spark, sf):
    return facts(spark, sf).filter("subject_id = 'u:8' and predicate = 'click' and group_id = 'g0' and expired_at is null").select("id", "object_value")


def fact_by_id_in_namespace(spark, sf):
    return facts(spark, sf).filter("id = 77 and group_id in ('g0', 'g1', 'g2', 'g3')").select("id", "subject_id", "group_id")


def episodes_by_source(spark, sf):
    return episodes(spark, sf).filter("source_id = 'src3'").select("id", "group_id", "timestamp")


def edges_for_entity(spark, sf):
    return edges(spark, sf).filter("subject_id = 'p:7'").select("episode_id", "object_id", "valid_from")


def insert_fact_dedup(spark, sf):
    """Of facts that say the same, the first active one is kept; expired ones do not count."""
    return mutate.accepted(facts(spark, sf)).select("id", "subject_id", "predicate", "object_value")


def try_insert_outcome(spark, sf):
    """Half the facts are there already; what becomes of the others."""
    f = facts(spark, sf)
    return mutate.insert_outcome(f.filter("id % 2 = 0"), f.filter("id % 2 = 1")).groupBy("outcome").agg(F.count("*").alias("n"))


def upsert_entities(spark, sf):
    """Later rows of a name overwrite its type; the first one's source stays."""
    n = names(spark, sf).select(F.col("name").alias("key"), "group_id", F.col("type_name").alias("type"), F.col("id").alias("at"))
    return mutate.upserted(n, ["key", "group_id"], "at", last=["type"], first=["at"])


def episodic_edge_presence(spark, sf):
    return edges(spark, sf).select("episode_id", F.col("subject_id").alias("entity_id")).distinct()


def invalidate_facts(spark, sf):
    f = facts(spark, sf)
    return mutate.invalidate(f, F.col("id") % 7 == 0, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")).select("id", "expired_at", "invalid_at")


def bound_valid_to(spark, sf):
    f = facts(spark, sf)
    return mutate.bound(f, F.col("predicate") == "error", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("id", "valid_to", "rejected")


def delete_cascade(spark, sf):
    """Facts left when entities of a prefix are deleted with all that mentions them."""
    return mutate.without(edges(spark, sf), F.col("object_id").startswith("s:1")).groupBy("object_id").agg(F.count("*").alias("n"))


def graph_export(spark, sf):
    return edges(spark, sf).filter("active").select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), "predicate").distinct()


def move_group(spark, sf):
    return facts(spark, sf).select("id", F.when(F.col("group_id") == "g3", "g0").otherwise(F.col("group_id")).alias("group_id"))


def duplicate_names(spark, sf):
    """Each surplus row of a normalised name."""
    from pyspark.sql import Window

    n = names(spark, sf).withColumn("norm", text.normalize_name(F.col("name")))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("norm").orderBy("id"))).filter("k > 1").select("id", "norm")


def new_entity_filter(spark, sf):
    """Names not known before, first occurrence only."""
    n = names(spark, sf).withColumn("norm", text.normalize_name(F.col("name")))
    known = n.filter("id < 100").select("norm").distinct()
    return n.filter("id >= 100").join(known, "norm", "left_anti").groupBy("norm").agg(F.min("id").alias("id"))


def forward_references(spark, sf):
    """Objects of facts that no entity row names, by first place."""
    have = raw(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("object_id"))
    return edges(spark, sf).join(have, "object_id", "left_anti").groupBy("object_id").agg(F.min("episode_id").alias("first_seen"))


def endpoint_resolution(spark, sf):
    mapping = names(spark, sf).groupBy("name").agg(F.min("id").alias("mapped"))
    out = names(spark, sf).join(mapping, "name", "left")
    return out.select("id", F.coalesce(F.col("mapped").cast("string"), text.normalize_name(F.col("name"))).alias("endpoint"))


QUERIES = {
    "scan_entities": (scan_entities, "SELECT c_custkey AS id, c_mktsegment AS group_id, coalesce(n_name, 'Entity') AS label FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"),
    "get_entity": (get_entity, with_sql(NAMES_SQL, body="SELECT id, name, group_id FROM names WHERE id = 42")),
    "keyset_entities": (keyset_entities, with_sql(NAMES_SQL, body="SELECT id, group_id FROM names WHERE id > 100 OR (id = 100 AND group_id > 'Brand#1') ORDER BY id, group_id LIMIT 50")),
    "keyset_facts": (keyset_facts, with_sql(FACTS_SQL, body="SELECT id, concat_ws(' ', subject_id, predicate, object_value) AS text FROM facts WHERE id > 500 ORDER BY id LIMIT 50")),
    "missing_embeddings": (missing_embeddings, with_sql(EPISODES_SQL, body="SELECT id, group_id FROM episodes WHERE id NOT IN (SELECT vec_id FROM embeddings)")),
    "facts_by_key": (facts_by_key, with_sql(FACTS_SQL, body="SELECT id, object_value FROM facts WHERE subject_id = 'u:8' AND predicate = 'click' AND group_id = 'g0' AND expired_at IS NULL")),
    "fact_by_id_in_namespace": (fact_by_id_in_namespace, with_sql(FACTS_SQL, body="SELECT id, subject_id, group_id FROM facts WHERE id = 77")),
    "episodes_by_source": (episodes_by_source, with_sql(EPISODES_SQL, body="SELECT id, group_id, timestamp FROM episodes WHERE source_id = 'src3'")),
    "edges_for_entity": (edges_for_entity, with_sql(EDGES_SQL, body="SELECT episode_id, object_id, valid_from FROM edges WHERE subject_id = 'p:7'")),
    "insert_fact_dedup": (insert_fact_dedup, with_sql(FACTS_SQL, body="SELECT id, subject_id, predicate, object_value FROM facts QUALIFY expired_at IS NOT NULL OR row_number() OVER (PARTITION BY subject_id, predicate, object_value, expired_at IS NULL ORDER BY id) = 1")),
    "try_insert_outcome": (try_insert_outcome, with_sql(FACTS_SQL, "old AS (SELECT DISTINCT subject_id, predicate, object_value FROM facts WHERE id % 2 = 0 AND expired_at IS NULL)", "fresh AS (SELECT f.*, row_number() OVER (PARTITION BY subject_id, predicate, object_value ORDER BY id) AS k FROM facts f WHERE id % 2 = 1)", body="SELECT CASE WHEN o.subject_id IS NOT NULL OR k > 1 THEN 'duplicate' ELSE 'inserted' END AS outcome, count(*) AS n FROM fresh f LEFT JOIN old o USING (subject_id, predicate, object_value) GROUP BY 1")),
    "upsert_entities": (upsert_entities, with_sql(NAMES_SQL, body="SELECT name AS key, group_id, arg_max(type_name, id) AS type, min(id) AS at FROM names GROUP BY name, group_id")),
    "episodic_edge_presence": (episodic_edge_presence, with_sql(EDGES_SQL, body="SELECT DISTINCT episode_id, subject_id AS entity_id FROM edges")),
    "invalidate_facts": (invalidate_facts, with_sql(FACTS_SQL, body="SELECT id, CASE WHEN id % 7 = 0 AND expired_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE expired_at END AS expired_at, CASE WHEN id % 7 = 0 AND expired_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' END AS invalid_at FROM facts")),
    "bound_valid_to": (bound_valid_to, with_sql(FACTS_SQL, body="SELECT id, CASE WHEN predicate = 'error' AND valid_from <= TIMESTAMP '2024-01-20 00:00:00' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE valid_to END AS valid_to, predicate = 'error' AND valid_from > TIMESTAMP '2024-01-20 00:00:00' AS rejected FROM facts")),
    "delete_cascade": (delete_cascade, with_sql(EDGES_SQL, body="SELECT object_id, count(*) AS n FROM edges WHERE NOT starts_with(object_id, 's:1') GROUP BY object_id")),
    "graph_export": (graph_export, with_sql(EDGES_SQL, body="SELECT DISTINCT subject_id AS src, object_id AS dst, predicate FROM edges WHERE active")),
    "move_group": (move_group, with_sql(FACTS_SQL, body="SELECT id, CASE WHEN group_id = 'g3' THEN 'g0' ELSE group_id END AS group_id FROM facts")),
    "duplicate_names": (duplicate_names, with_sql(NAMES_SQL, r"n AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM names)", body="SELECT id, norm FROM n QUALIFY row_number() OVER (PARTITION BY norm ORDER BY id) > 1")),
    "new_entity_filter": (new_entity_filter, with_sql(NAMES_SQL, r"n AS (SELECT id, trim(regexp_replace(regexp_replace(lower(name), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM names)", body="SELECT norm, min(id) AS id FROM n WHERE id >= 100 AND norm NOT IN (SELECT norm FROM n WHERE id < 100) GROUP BY norm")),
    "forward_references": (forward_references, with_sql(EDGES_SQL, body="SELECT object_id, min(episode_id) AS first_seen FROM edges WHERE object_id NOT IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY object_id")),
    "endpoint_resolution": (endpoint_resolution, with_sql(NAMES_SQL, "m AS (SELECT name, min(id) AS mapped FROM names GROUP BY name)", body="SELECT id, CAST(mapped AS VARCHAR) AS endpoint FROM names JOIN m USING (name)")),
}
