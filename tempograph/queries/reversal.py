"""Edits and what takes them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.operators import mutate, resolve, reversal
from tempograph.sources.adapters import EDGES_SQL, FACTS_SQL, VECTORS_SQL, edges, facts, raw, vectors, with_sql

from .batch import PAIRS, allpairs_cosine


def numbered(spark, sf):
    """Orders as facts between customers and ten suppliers, with an id of their own."""
    o = raw(spark, sf, "orders")
    supplier = (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 10
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("subject_id"), F.concat(F.lit("s:"), supplier.cast("string")).alias("object_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("expired_at"))


def suppliers(spark, sf):
    return raw(spark, sf, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey", "s_nationkey")


def merged_suppliers(spark, sf):
    """Suppliers in threes: the second and the third go to the first."""
    s = suppliers(spark, sf).filter("s_suppkey % 3 <> 0")
    return s.select(F.col("id").alias("loser"), F.concat(F.lit("s:"), (F.col("s_suppkey") - F.col("s_suppkey") % 3).cast("string")).alias("keeper"))


def unmerge_refusals(spark, sf):
    """Parts merged into the part of half their number, in order of the number; a fifth is undone already."""
    m = raw(spark, sf, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("loser"), F.floor(F.col("p_partkey") / 2).alias("keeper"), (F.col("p_partkey") % 5 == 0).alias("undone"))
    return reversal.refusals(m).select("id", "refused")


def undo_merge(spark, sf):
    """Suppliers become one and are taken apart again: facts and live ones per supplier."""
    f = numbered(spark, sf)
    after, log = mutate.merge(f, merged_suppliers(spark, sf), 1, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    back = mutate.undo(after, log, 1)
    return back.groupBy("object_id").agg(F.count("*").alias("n"), F.count_if(F.col("expired_at").isNull()).alias("live"))


def merge_log(spark, sf):
    """What the log of that merge holds, per supplier as it was."""
    _, log = mutate.merge(numbered(spark, sf), merged_suppliers(spark, sf), 1, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return log.groupBy(F.get_json_object("pre_state", "$.object_id").alias("object_id")).agg(F.count("*").alias("n"))


def restored_facts(spark, sf):
    """Every seventh fact is asked back: the archive has the expired ones, and copies of some that live."""
    f = facts(spark, sf)
    archived = f.filter("expired_at is not null or id % 10 = 0")
    return reversal.restored(archived, f.filter("expired_at is null"), f.filter("id % 7 = 0").select("id"))


def undo_supersede(spark, sf):
    """Bounds of clicks are taken back, unless the end was changed after (every fourth)."""
    f = facts(spark, sf).filter("predicate = 'click'")
    end = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    log = f.select("id", F.col("valid_to").alias("before"), end.alias("bound"))
    now = f.withColumn("valid_to", F.when(F.col("id") % 4 == 0, F.expr("valid_from + interval 1 hour")).otherwise(end))
    return reversal.reset(now, log).select("id", "valid_to", "stale")


def renames(spark, sf):
    s = suppliers(spark, sf).filter("s_suppkey % 3 = 0")
    new = F.when(F.col("s_suppkey") % 2 == 0, F.concat("id", F.lit("-renamed"))).otherwise(F.concat(F.lit("s:"), (F.col("s_suppkey") - 1).cast("string")))
    return s.select(F.col("id").alias("old"), new.alias("new"))


def renamed_entities(spark, sf):
    """Facts per supplier after renames; those to an id that exists are refused."""
    after, _, _ = reversal.rename(numbered(spark, sf), suppliers(spark, sf), renames(spark, sf))
    return after.groupBy("object_id").agg(F.count("*").alias("n"))


def refused_renames(spark, sf):
    return reversal.rename(numbered(spark, sf), suppliers(spark, sf), renames(spark, sf))[2]


def undo_rename(spark, sf):
    f = numbered(spark, sf)
    after, log, _ = reversal.rename(f, suppliers(spark, sf), renames(spark, sf))
    return reversal.restore_ends(after, log).groupBy("object_id").agg(F.count("*").alias("n"))


def gone(spark, sf):
    return suppliers(spark, sf).filter("s_suppkey % 2 = 0").select("id")


def deleted_entities(spark, sf):
    """Half the suppliers go: facts left, archived, and customers without support, by what becomes of them."""
    left, archived, bare = reversal.delete(numbered(spark, sf), gone(spark, sf))
    count = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(left, "left").union(count(archived, "archived")).union(count(bare, "bare"))


def undo_delete(spark, sf):
    left, archived, _ = reversal.delete(numbered(spark, sf), gone(spark, sf))
    return left.unionByName(archived).groupBy("object_id").agg(F.count("*").alias("n"))


def retracted_neighbours(spark, sf):
    """Customers that a delete leaves bare lose their community, and get it back from the log when it is undone."""
    _, _, bare = reversal.delete(numbered(spark, sf), gone(spark, sf))
    community = raw(spark, sf, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("community"))
    lost = bare.select("id", F.lit(True).alias("lost"))
    return community.join(lost, "id").select("id", F.lit(None).cast("string").alias("during"), F.col("community").alias("after_undo"))


def unified_undo(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("merge", "archive", "supersede", "rename", "retype", "delete", "other")])
    e = raw(spark, sf, "events")
    return e.select("event_id", reversal.undo_of(F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int"))).alias("undo"))


def split_entity(spark, sf):
    """Every third fact of supplier 3 was another's."""
    f = numbered(spark, sf)
    return reversal.split(f, f.filter("id % 3 = 0").select("id"), "s:3", "s:3-split").filter("object_id like 's:3%'").groupBy("object_id").agg(F.count("*").alias("n"))


def reopened_keys(spark, sf):
    keys = edges(spark, sf).select(F.col("object_id").alias("entity_id"), F.col("episode_id").alias("pass_id")).distinct()
    return reversal.reopened(keys, gone(spark, sf)).groupBy("entity_id").agg(F.count("*").alias("keys"))


def merge_self_loops(spark, sf):
    """Facts between neighbours of a chain of parts, and what merging each even one into the odd one before makes of them."""
    p = raw(spark, sf, "part")
    f = p.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("subject_id"), (F.col("p_partkey") + 1).alias("object_id"))
    merged = p.filter("p_partkey % 4 = 2").select(F.col("p_partkey").alias("loser"), (F.col("p_partkey") - 1).alias("keeper"))
    return reversal.loops_after(f, merged).select("id")


def verdicts(spark, sf):
    p = allpairs_cosine(spark, sf)
    k = F.col("a") + F.col("b")
    return p.select("a", "b", "score", F.when(k % 5 != 0, k % 5 > 1).alias("is_same"), ((k % 10) / 10).alias("confidence"), (k % 7 == 0).alias("conflict"))


def adjudicated_merges(spark, sf):
    """Pairs that are near with a model's verdict: what is applied and what is written to the audit."""
    v = verdicts(spark, sf)
    decided = v.withColumn("decision", resolve.write_gate(F.col("conflict"), F.lit("Merge"), F.col("is_same"), F.col("confidence")))
    return decided.select("a", "b", "decision", (F.col("decision") == "Merge").alias("applied"))


NUMBERED = "numbered AS (SELECT o_orderkey AS id, 'c:' || o_custkey AS subject_id, 's:' || ((o_orderkey * 7 + o_custkey) % 10) AS object_id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS expired_at FROM orders)"
RENAMES = "ren AS (SELECT 's:' || s_suppkey AS old, CASE WHEN s_suppkey % 2 = 0 THEN 's:' || s_suppkey || '-renamed' ELSE 's:' || (s_suppkey - 1) END AS new FROM supplier WHERE s_suppkey % 3 = 0), ref AS (SELECT * FROM ren WHERE new IN (SELECT 's:' || s_suppkey FROM supplier)), tak AS (SELECT * FROM ren WHERE new NOT IN (SELECT 's:' || s_suppkey FROM supplier))"
GONE = "gone AS (SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_suppkey % 2 = 0), bare AS (SELECT DISTINCT subject_id AS id FROM numbered WHERE object_id IN (SELECT id FROM gone) AND subject_id NOT IN (SELECT subject_id FROM numbered WHERE expired_at IS NULL AND object_id NOT IN (SELECT id FROM gone)))"
PER_SUPPLIER = f"WITH {NUMBERED} SELECT object_id, count(*) AS n FROM numbered GROUP BY object_id"

QUERIES = {
    "unmerge_refusals": (unmerge_refusals, "WITH m AS (SELECT p_partkey AS id, p_partkey AS loser, p_partkey // 2 AS keeper, p_partkey % 5 = 0 AS undone FROM part WHERE p_partkey > 0), s AS (SELECT id, unnest([loser, keeper]) AS party FROM m WHERE NOT undone), l AS (SELECT party, max(id) AS last FROM s GROUP BY party) SELECT m.id, NOT undone AND greatest(coalesce(a.last, -1), coalesce(b.last, -1)) > m.id AS refused FROM m LEFT JOIN l a ON a.party = m.loser LEFT JOIN l b ON b.party = m.keeper"),
    "undo_merge": (undo_merge, with_sql(NUMBERED, body="SELECT object_id, count(*) AS n, count(*) FILTER (WHERE expired_at IS NULL) AS live FROM numbered GROUP BY object_id")),
    "merge_log": (merge_log, with_sql(NUMBERED, body="SELECT object_id, count(*) AS n FROM numbered WHERE CAST(substring(object_id, 3) AS BIGINT) % 3 <> 0 GROUP BY object_id")),
    "restored_facts": (restored_facts, with_sql(FACTS_SQL, body="SELECT id, CASE WHEN NOT (expired_at IS NOT NULL OR id % 10 = 0) THEN 'missing' WHEN expired_at IS NULL THEN 'copy dropped' ELSE 'restored' END AS outcome FROM facts WHERE id % 7 = 0")),
    "undo_supersede": (undo_supersede, with_sql(FACTS_SQL, body="SELECT id, CASE WHEN id % 4 = 0 THEN valid_from + INTERVAL 1 HOUR ELSE valid_to END AS valid_to, id % 4 = 0 AS stale FROM facts WHERE predicate = 'click'")),
    "renamed_entities": (renamed_entities, with_sql(NUMBERED, RENAMES, body="SELECT coalesce(new, object_id) AS object_id, count(*) AS n FROM numbered LEFT JOIN tak ON old = object_id GROUP BY 1")),
    "refused_renames": (refused_renames, with_sql(RENAMES, body="SELECT old, new FROM ref")),
    "undo_rename": (undo_rename, PER_SUPPLIER),
    "deleted_entities": (deleted_entities, with_sql(NUMBERED, GONE, body="SELECT 'left' AS what, count(*) AS n FROM numbered WHERE object_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'archived', count(*) FROM numbered WHERE object_id IN (SELECT id FROM gone) UNION ALL SELECT 'bare', count(*) FROM bare")),
    "undo_delete": (undo_delete, PER_SUPPLIER),
    "retracted_neighbours": (retracted_neighbours, with_sql(NUMBERED, GONE, body="SELECT id, CAST(NULL AS VARCHAR) AS during, c_mktsegment AS after_undo FROM bare JOIN customer ON id = 'c:' || c_custkey")),
    "unified_undo": (unified_undo, "SELECT event_id, ['unmerge', 'restore', 'reset', 'rename', 'retype', 'restore', 'unknown'][event_id % 7 + 1] AS undo FROM events"),
    "split_entity": (split_entity, with_sql(NUMBERED, body="SELECT CASE WHEN object_id = 's:3' AND id % 3 = 0 THEN 's:3-split' ELSE object_id END AS object_id, count(*) AS n FROM numbered WHERE object_id LIKE 's:3%' GROUP BY 1")),
    "reopened_keys": (reopened_keys, "SELECT 's:' || l_suppkey AS entity_id, count(DISTINCT l_orderkey) AS keys FROM lineitem WHERE l_suppkey % 2 = 1 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY l_suppkey"),
    "merge_self_loops": (merge_self_loops, "SELECT p_partkey AS id FROM part WHERE (p_partkey + 1) IN (SELECT p_partkey FROM part WHERE p_partkey % 4 = 2)"),
    "adjudicated_merges": (adjudicated_merges, with_sql(VECTORS_SQL, PAIRS, "v AS (SELECT a, b, (a + b) % 5 AS m, ((a + b) % 10) / 10.0 AS c, (a + b) % 7 = 0 AS x FROM pairs)", "d AS (SELECT a, b, CASE WHEN x THEN 'Reject' WHEN m = 0 THEN 'Merge' WHEN m <= 1 THEN 'Reject' WHEN c < 0.7 THEN 'PotentialAlias' ELSE 'Merge' END AS decision FROM v)", body="SELECT a, b, decision, decision = 'Merge' AS applied FROM d")),
}
