"""Schemas of the knowledge-graph tables."""

from __future__ import annotations

from pyspark.sql import types as T


KINDS = {
    "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "timestamp_ntz": T.TimestampNTZType(), "array<float>": T.ArrayType(T.FloatType()),
}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, KINDS[kind]) for name, kind in (f.split() for f in text.split(","))])


ENTITIES = _struct("id string, group_id string, properties string, embedding array<float>, recorded_at timestamp_ntz, updated_at timestamp_ntz, access_count bigint, entity_type_id int, entity_type_source string, ner_confidence double, is_dream_generated boolean")
FACTS = _struct("id bigint, subject_id string, predicate string, object_id string, object_value string, properties string, valid_from timestamp_ntz, valid_to timestamp_ntz, recorded_at timestamp_ntz, expired_at timestamp_ntz, invalid_at timestamp_ntz, group_id string, confidence double, source_episode_id bigint, content_hash string, access_count bigint, is_dream_generated boolean")
EPISODES = _struct("id bigint, content string, timestamp timestamp_ntz, recorded_at timestamp_ntz, source_type string, metadata string, group_id string, saga_id string, sequence_number bigint, source_id string, content_hash string, status string, embedding array<float>")
EPISODIC_EDGES = _struct("episode_id bigint, entity_id string, role string, entity_group_id string")
MUTATIONS = _struct("id bigint, kind string, group_id string, created_at timestamp_ntz, undone_at timestamp_ntz, pre_state string, inputs string")

ENTITY_TYPES = _struct("group_id string, id int, name string, description string, created_at timestamp_ntz, last_used_at timestamp_ntz, use_count bigint, evidence_count bigint, confidence double")
NAMESPACES = _struct("group_id string, policy_json string, recorded_at timestamp_ntz, schema_version int, upgraded_at timestamp_ntz")
TABLES = {"entities": ENTITIES, "facts": FACTS, "episodes": EPISODES, "episodic_edges": EPISODIC_EDGES, "graph_mutation_log": MUTATIONS, "entity_types": ENTITY_TYPES, "namespaces": NAMESPACES}
#: What an integrity check wants to find.
CRITICAL = ("entities", "facts", "episodes", "episodic_edges", "entity_types", "namespaces")
