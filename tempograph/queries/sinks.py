"""What ingestion writes, and the reads that go with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph import schema
from tempograph.functions import text
from tempograph.operators import ingest
from tempograph.sources.adapters import EDGES_SQL, EPISODES_SQL, FACTS_SQL, NAMES_SQL, VECTORS_SQL, edges, episodes, facts, names, raw, vectors, with_sql

from .batch import CUT, PAIRS, allpairs_cosine
from .scalar import norm, tok


def keyset_episodes(spark, sf):
    page = episodes(spark, sf).filter("id > 40").orderBy("id").limit(50)
    return page.select("id", F.sha2("content", 256).alias("content_hash"))


def episode_source(spark, sf):
    return episodes(spark, sf).filter("id = 42").select("source_id")


def alias_facts_of(spark, sf):
    """Facts of one kind stand for pending aliases."""
    return facts(spark, sf).withColumn("predicate", F.when(F.col("predicate") == "error", "potential_alias").otherwise(F.col("predicate")))


def pending_aliases(spark, sf):
    return alias_facts_of(spark, sf).filter("predicate = 'potential_alias' and expired_at is null and group_id = 'g1'").select("id", "subject_id", "object_value")


def reserved_predicates(spark, sf):
    """Facts that a search may show."""
    from tempograph.functions.gates import reserved

    return alias_facts_of(spark, sf).filter(~reserved(F.col("predicate"))).groupBy("predicate").agg(F.count("*").alias("n"))


def insert_entity_terms(spark, sf):
    """New entities with the rows of their names' words, as one write."""
    fresh = names(spark, sf).filter("id % 2 = 1")
    return fresh.select("id", "group_id", F.explode(F.array_distinct(text.tokens(F.col("name")))).alias("term"))


def insert_episodes(spark, sf):
    e = ingest.sagas(episodes(spark, sf))
    return e.select("id", "saga_id", "sequence_number", "content_hash")


def set_embeddings(spark, sf):
    """Where there is no vector one is set, in one namespace; others stay."""
    v = vectors(spark, sf).withColumn("embedding", F.when(F.col("id") % 3 != 0, F.col("embedding")))
    new = vectors(spark, sf).filter("group_id = 'g1'").select("id", F.col("embedding").alias("made"))
    out = v.join(new, "id", "left").withColumn("embedding", F.coalesce("embedding", "made"))
    return out.select("id", F.col("embedding").isNotNull().alias("has"), F.round(F.coalesce(F.element_at("embedding", 1), F.lit(0.0)), 6).alias("first"))


def reembed_counts(spark, sf):
    """Pages of 64 ids: how many texts an embedder takes and how many it cannot."""
    e = episodes(spark, sf).withColumn("page", F.floor(F.col("id") / 64))
    ok = F.trim("content") != ""
    return e.groupBy("page").agg(F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))


def upsert_extracted(spark, sf):
    """Parts as names found in a text, half of them known by a like name."""
    n = names(spark, sf)
    shuffled = F.array_join(F.reverse(F.split("name", " ")), " ")
    found = n.select("id", F.when(F.col("id") % 3 == 0, F.upper("name")).when(F.col("id") % 3 == 1, shuffled).otherwise(F.concat("name", F.lit(" x"), F.col("id").cast("string"))).alias("name"))
    known = n.filter("id % 2 = 0").select("id", "name")
    return ingest.resolved(found.withColumnRenamed("id", "mention"), known).select("mention", "decision", "entity")


def pinned_stubs(spark, sf):
    """Ends of pinned facts that are no entities yet."""
    pinned = edges(spark, sf).filter("not active").select("subject_id", "object_id")
    have = raw(spark, sf, "part").filter("p_size > 25").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"))
    return ingest.stubs(pinned, have)


def verified_entities(spark, sf):
    """Candidates of the first phase that a verdict lets through, with what was decided."""
    n = names(spark, sf).withColumn("verdict", F.element_at(F.array(F.lit("confirm"), F.lit("correct"), F.lit("reject")), (F.col("id") % 3 + 1).cast("int")))
    return n.filter("verdict <> 'reject'").select("id", "group_id", "verdict")


def potential_alias_facts(spark, sf):
    return ingest.alias_facts(allpairs_cosine(spark, sf), 0.3, 0.5)


def alias_endpoints(spark, sf):
    """Alias facts whose two ends are entities of the same namespace."""
    f = ingest.alias_facts(allpairs_cosine(spark, sf), 0.3, 0.5)
    v = vectors(spark, sf).select("id", "group_id")
    a, b = v.toDF("subject_id", "ga"), v.toDF("object_id", "gb")
    return f.join(a, "subject_id").join(b, "object_id").filter("ga = gb").select("subject_id", "object_id", F.col("ga").alias("group_id"), "confidence")


def retyped_entities(spark, sf):
    """Type, tier and confidence of every fifth entity, set by a table of changes."""
    v = vectors(spark, sf).select("id", "entity_type_id", F.lit("ner").alias("source"), ((F.col("id") % 100) / 100).alias("confidence"))
    changes = v.filter("id % 5 = 0").select("id", (F.col("entity_type_id") + 1).alias("entity_type_id"), F.when(F.col("id") % 10 == 0, "pinned").alias("source"), F.lit(0.95).alias("confidence"))
    return ingest.updated(v, changes, "id", ["entity_type_id", "source", "confidence"])


def replaced_properties(spark, sf):
    n = names(spark, sf).select("id", F.to_json(F.struct("name")).alias("properties"))
    changes = n.filter("id % 4 = 0").select("id", F.to_json(F.struct(F.concat(F.lit("part "), F.col("id").cast("string")).alias("name"))).alias("properties"))
    return ingest.updated(n, changes, "id", ["properties"]).select("id", F.get_json_object("properties", "$.name").alias("name"))


def ingested_documents(spark, sf):
    """Documents as anchors with their windows: how many entities and edges each gives."""
    d = episodes(spark, sf).withColumnRenamed("content", "body_text")
    _, links = ingest.document_graph(d, text.word_windows(F.col("body_text")))
    return links.groupBy("subject_id").agg(F.count("*").alias("parts"))


def remembered_batches(spark, sf):
    e = episodes(spark, sf).withColumn("batch_id", F.concat_ws("-", "source_id", F.to_date("timestamp").cast("string")))
    return e.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def critical_tables(spark, sf):
    """The tables that must be there, and whether the schema has them."""
    return spark.createDataFrame([(name, name in schema.TABLES) for name in schema.CRITICAL], "name string, present boolean")


def registered_types(spark, sf):
    """Types of parts looked up in a registry of regions and nations' names; new ones get the next numbers."""
    registry = raw(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    wanted = names(spark, sf).select(F.col("type_name").alias("name")).union(raw(spark, sf, "nation").select(F.lower("n_name")))
    return ingest.registered(wanted, registry)


def resolved_registry(spark, sf):
    """Type names under a call's own numbers, then the registry's, then the catch-all."""
    registry = raw(spark, sf, "nation").filter("n_nationkey < 15").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    override = raw(spark, sf, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_name").alias("name"), (F.col("n_nationkey") + 100).alias("own"))
    asked = raw(spark, sf, "nation").select(F.col("n_name").alias("name"))
    both = asked.join(registry, "name", "left").join(override, "name", "left")
    return both.select("name", F.coalesce("own", "id", F.lit(0)).cast("long").alias("type_id"))


def group_keys(spark, sf):
    """Namespace and thread as one key; without a thread the namespace alone."""
    e = episodes(spark, sf).withColumn("thread", F.when(F.col("id") % 2 == 0, F.col("source_id")))
    return e.select("id", text.group_key(F.col("group_id"), F.col("thread")).alias("key"))


def facts_with_episodes(spark, sf):
    """Facts joined with the episode that they come from: how world time lies to it."""
    e = episodes(spark, sf).select(F.col("id").alias("source_episode_id"), "timestamp", F.col("group_id").alias("lang"))
    both = facts(spark, sf).join(e, "source_episode_id")
    return both.select("id", "lang", F.when(F.to_date("valid_from") < F.to_date("timestamp"), "back").when(F.to_date("valid_from") > F.to_date("timestamp"), "forward").otherwise("same").alias("lies"))


WORDS = "array_to_string(list_sort(list_distinct({0})), ' ')"
CHANGED = "CASE WHEN id % 3 = 0 THEN upper(name) WHEN id % 3 = 1 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ') ELSE name || ' x' || id END"

QUERIES = {
    "keyset_episodes": (keyset_episodes, with_sql(EPISODES_SQL, body="SELECT id, sha256(content) AS content_hash FROM episodes WHERE id > 40 ORDER BY id LIMIT 50")),
    "episode_source": (episode_source, with_sql(EPISODES_SQL, body="SELECT source_id FROM episodes WHERE id = 42")),
    "pending_aliases": (pending_aliases, with_sql(FACTS_SQL, body="SELECT id, subject_id, object_value FROM facts WHERE predicate = 'error' AND expired_at IS NULL AND group_id = 'g1'")),
    "reserved_predicates": (reserved_predicates, with_sql(FACTS_SQL, body="SELECT predicate, count(*) AS n FROM facts WHERE predicate <> 'error' GROUP BY predicate")),
    "insert_entity_terms": (insert_entity_terms, with_sql(NAMES_SQL, body=f"SELECT id, group_id, unnest(list_distinct({tok('name')})) AS term FROM names WHERE id % 2 = 1")),
    "insert_episodes": (insert_episodes, with_sql(EPISODES_SQL, body="SELECT id, source_id AS saga_id, row_number() OVER (PARTITION BY source_id ORDER BY timestamp, id) AS sequence_number, sha256(content) AS content_hash FROM episodes")),
    "set_embeddings": (set_embeddings, with_sql(VECTORS_SQL, body="SELECT id, id % 3 <> 0 OR group_id = 'g1' AS has, round(CASE WHEN id % 3 <> 0 OR group_id = 'g1' THEN embedding[1] ELSE 0.0 END, 6) AS first FROM vectors")),
    "reembed_counts": (reembed_counts, with_sql(EPISODES_SQL, body="SELECT id // 64 AS page, count(*) FILTER (WHERE trim(content) <> '') AS succeeded, count(*) FILTER (WHERE trim(content) = '') AS failed FROM episodes GROUP BY 1")),
    "upsert_extracted": (upsert_extracted, with_sql(NAMES_SQL, f"x AS (SELECT id AS mention, {CHANGED} AS name FROM names)", f"f AS (SELECT mention, {norm('name')} AS nn, {WORDS.format(tok('name'))} AS ww FROM x)", f"k AS (SELECT id, {norm('name')} AS nn, {WORDS.format(tok('name'))} AS ww FROM names WHERE id % 2 = 0)", "s AS (SELECT nn, min(id) AS same FROM k GROUP BY nn)", "l AS (SELECT ww, min(id) AS lik FROM k GROUP BY ww)", body="SELECT mention, CASE WHEN same IS NOT NULL THEN 'reuse' WHEN lik IS NOT NULL THEN 'alias' ELSE 'insert' END AS decision, coalesce(same, lik) AS entity FROM f LEFT JOIN s USING (nn) LEFT JOIN l USING (ww)")),
    "pinned_stubs": (pinned_stubs, with_sql(EDGES_SQL, "e AS (SELECT subject_id AS id FROM edges WHERE NOT active UNION SELECT object_id FROM edges WHERE NOT active)", body="SELECT id FROM e WHERE id NOT IN (SELECT 'p:' || p_partkey FROM part WHERE p_size > 25)")),
    "verified_entities": (verified_entities, with_sql(NAMES_SQL, body="SELECT id, group_id, CASE id % 3 WHEN 0 THEN 'confirm' ELSE 'correct' END AS verdict FROM names WHERE id % 3 <> 2")),
    "potential_alias_facts": (potential_alias_facts, with_sql(VECTORS_SQL, PAIRS, body="SELECT a AS subject_id, 'potential_alias' AS predicate, b AS object_id, score AS confidence FROM pairs WHERE score >= 0.3 AND score < 0.5")),
    "alias_endpoints": (alias_endpoints, with_sql(VECTORS_SQL, PAIRS, body="SELECT a AS subject_id, b AS object_id, x.group_id, score AS confidence FROM pairs JOIN vectors x ON x.id = a JOIN vectors y ON y.id = b AND y.group_id = x.group_id WHERE score >= 0.3 AND score < 0.5")),
    "retyped_entities": (retyped_entities, with_sql(VECTORS_SQL, body="SELECT id, CASE WHEN id % 5 = 0 THEN entity_type_id + 1 ELSE entity_type_id END AS entity_type_id, CASE WHEN id % 10 = 0 THEN 'pinned' ELSE 'ner' END AS source, CASE WHEN id % 5 = 0 THEN 0.95::DOUBLE ELSE (id % 100) / 100.0::DOUBLE END AS confidence FROM vectors")),
    "replaced_properties": (replaced_properties, with_sql(NAMES_SQL, body="SELECT id, CASE WHEN id % 4 = 0 THEN 'part ' || id ELSE name END AS name FROM names")),
    "ingested_documents": (ingested_documents, with_sql(EPISODES_SQL, "w AS (SELECT id, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS n FROM episodes)", body="SELECT 'doc:' || id AS subject_id, greatest(1, CAST(ceil((n - 50) / 250.0) AS BIGINT)) AS parts FROM w")),
    "remembered_batches": (remembered_batches, with_sql(EPISODES_SQL, body="SELECT concat_ws('-', source_id, CAST(CAST(timestamp AS DATE) AS VARCHAR)) AS batch_id, count(*) AS n, min(id) AS first_id FROM episodes GROUP BY 1")),
    "critical_tables": (critical_tables, "SELECT unnest(['entities', 'facts', 'episodes', 'episodic_edges', 'entity_types', 'namespaces']) AS name, unnest([true, true, true, true, true, true]) AS present"),
    "registered_types": (registered_types, with_sql(NAMES_SQL, "w AS (SELECT lower(trim(type_name)) AS key, type_name AS name FROM names UNION ALL SELECT lower(n_name), lower(n_name) FROM nation)", "d AS (SELECT key, min(name) AS name FROM w GROUP BY key)", "j AS (SELECT d.*, n_nationkey AS known FROM d LEFT JOIN nation ON lower(n_name) = key)", body="SELECT name, CAST(known AS BIGINT) AS type_id FROM j WHERE known IS NOT NULL UNION ALL SELECT name, (SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY key) FROM j WHERE known IS NULL")),
    "resolved_registry": (resolved_registry, "SELECT n_name AS name, CAST(CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey + 100 WHEN n_nationkey < 15 THEN n_nationkey ELSE 0 END AS BIGINT) AS type_id FROM nation"),
    "group_keys": (group_keys, with_sql(EPISODES_SQL, body="SELECT id, CASE WHEN id % 2 = 0 THEN group_id || ':' || source_id ELSE group_id END AS key FROM episodes")),
    "facts_with_episodes": (facts_with_episodes, with_sql(FACTS_SQL, EPISODES_SQL, body="SELECT f.id, e.group_id AS lang, CASE WHEN CAST(valid_from AS DATE) < CAST(timestamp AS DATE) THEN 'back' WHEN CAST(valid_from AS DATE) > CAST(timestamp AS DATE) THEN 'forward' ELSE 'same' END AS lies FROM facts f JOIN episodes e ON e.id = f.source_episode_id")),
}
