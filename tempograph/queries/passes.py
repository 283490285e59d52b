"""Passes that consolidate: cliques, communities, types, consistency, policies."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tempograph.functions import gates, text
from tempograph.operators import graph, mutate, resolve
from tempograph.sources.adapters import EDGES_SQL, FACTS_SQL, NAMES_SQL, VECTORS_SQL, edges, facts, names, raw, vectors, with_sql

from .batch import NAME_PAIRS, SHG
from .graphs import EARLY, ends, hops, seeds


NEAR = 0.3
UNDER = math.nextafter(NEAR, 0)  # over this is NEAR or more


def unparted(a, b):
    """Pairs that no user has parted."""
    return (a + b) % 4 != 0


def weighed(pairs):
    """Their cosine as an integer weight."""
    return pairs.withColumn("weight", F.round(F.col("score") * 1_000_000).cast("long")).drop("score")


def near_pairs(spark, sf):
    """Near pairs that no user has parted, with their cosine as an integer weight."""
    return weighed(resolve.similar_pairs(vectors(spark, sf), UNDER, allowed=unparted))


def maximal_cliques(spark, sf):
    """Cliques of each component of up to 32 entities."""
    inside = weighed(resolve.near_groups(vectors(spark, sf), UNDER, allowed=unparted))
    return resolve.cliques_inside(inside).select("component", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def cross_episode_merges(spark, sf):
    """Groups to merge: both ends in two episodes or more, corroborated by something rare that they share, in cliques that do not overlap."""
    seen = edges(spark, sf).select(F.expr("cast(substring(object_id, 3) as bigint)").alias("id"), "episode_id").groupBy("id").agg(F.countDistinct("episode_id").alias("episodes")).filter("episodes >= 2").select("id")
    p = near_pairs(spark, sf)
    for end in ("a", "b"):
        p = p.join(seen.withColumnRenamed("id", end), end, "left_semi")
    shared = vectors(spark, sf).select("id", "entity_type_id")
    frequency = shared.groupBy("entity_type_id").agg(F.count("*").alias("f"))
    both = p.join(shared.toDF("a", "ta"), "a").join(shared.toDF("b", "tb"), "b").join(frequency, F.col("ta") == F.col("entity_type_id"))
    weight = F.when(F.col("ta") == F.col("tb"), resolve.corroboration(F.ceil(F.col("f") / 100))).otherwise(0)
    kept = both.withColumn("shared", weight).filter(F.col("shared") >= gates.CORROBORATED).select("a", "b", "weight")
    return resolve.merge_groups(kept).select(F.element_at("members", 1).alias("keeper"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def persisted_communities(spark, sf):
    """Members of brands as communities, and whether each one's hash differs from what was stored before the last part came."""
    n = names(spark, sf)
    code = lambda rows, name: rows.groupBy("group_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.lpad(F.col("id").cast("string"), 9, "0")))), 256).alias(name), F.count("*").alias(f"{name}_n"))
    now, before = code(n, "now"), code(n.filter("id % 97 <> 5"), "before")
    return now.join(before, "group_id", "left").select("group_id", F.col("now_n").alias("members"), (~F.col("now").eqNullSafe(F.col("before"))).alias("changed"))


def live_facts(spark, sf):
    return facts(spark, sf).groupBy("group_id").agg(F.count_if(F.col("expired_at").isNull()).alias("live"))


def endpoint_live_facts(spark, sf):
    """Facts in force at either end of each entity; an archive waits for those that have none."""
    e = edges(spark, sf)
    ends = e.select(F.explode(F.array("subject_id", "object_id")).alias("id"), F.col("active").cast("int").alias("live"))
    return ends.groupBy("id").agg(F.sum("live").alias("live"))


def assertion_sets(spark, sf):
    """What each subject says, as keys of predicate and object."""
    key = F.concat_ws("␟", "predicate", "object_value")
    return facts(spark, sf).filter("expired_at is null").groupBy("subject_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(key)), "|"), 256).alias("keys"))


def canonical_merges(spark, sf):
    """Names that are alike go to the longest of them, ties to the least id, and on to where that one goes."""
    n = names(spark, sf).select("id", F.length("name").alias("n"))
    p = resolve.name_pairs(names(spark, sf)).join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    keeper = F.when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.col("a"))
    sided = p.select(keeper.alias("keeper"), (F.col("a") + F.col("b") - keeper).alias("loser"), F.greatest("na", "nb").alias("n"))
    best = sided.groupBy("loser").agg(F.max_by("keeper", F.struct("n", -F.col("keeper"))).alias("keeper"))
    return graph.survivors(best)


def acronym_nominations(spark, sf):
    """Parts of one brand that orders mention together and no user has parted, for a model to judge."""
    m = edges(spark, sf).select("episode_id", F.expr("cast(substring(subject_id, 3) as bigint)").alias("entity_id"))
    p = graph.cooccurrence(m)
    b = names(spark, sf).select("id", "group_id")
    both = p.join(b.toDF("a", "ga"), "a").join(b.toDF("b", "gb"), "b")
    return both.filter("ga = gb and (a + b) % 4 <> 0").select("a", "b", "weight")


def type_collapse_keepers(spark, sf):
    """Parts' names as types: of two that are alike the longer is kept; within five bytes the one with more parts."""
    t = names(spark, sf).groupBy("name").agg(F.count("*").alias("n"))
    own = t.select("name", "n", text.char_shingles(F.col("name")).alias("s"))
    a, b = own.toDF("a", "na", "sa"), own.toDF("b", "nb", "sb")
    near = a.join(b, F.col("a") < F.col("b")).filter(text.jaccard(F.col("sa"), F.col("sb")) > 0.3)
    gap = F.octet_length("a") - F.octet_length("b")
    first = F.when(F.abs(gap) <= 5, F.when(F.col("na") != F.col("nb"), F.col("na") > F.col("nb")).otherwise(gap >= 0)).otherwise(gap > 0)
    return near.select("a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("keeper"))


def retype_evidence(spark, sf):
    """Catch-all entities near enough a new type's description get it."""
    from .recall import vector_scores

    v = vectors(spark, sf).filter("entity_type_id = 0").select("id").join(vector_scores(spark, sf), "id")
    return v.select("id", F.when(F.round(F.col("score") + 0.55, 6) >= gates.RETYPE_COSINE, 11).otherwise(0).alias("entity_type_id"))


def consistency_candidates(spark, sf):
    """Users whose type is no pin, with their three latest facts and the last episode that names them."""
    latest = Window.partitionBy("subject_id").orderBy(F.col("recorded_at").desc(), F.col("id").desc())
    f = facts(spark, sf).filter("cast(substring(subject_id, 3) as bigint) % 5 <> 0").withColumn("k", F.row_number().over(latest))
    top = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(" ", "predicate", "object_value").alias("fact")))), lambda x: x.fact)
    return f.filter("k <= 3").groupBy("subject_id").agg(F.array_join(top, "; ").alias("facts"), F.max_by("source_episode_id", -F.col("k")).alias("episode"))


def verified_types(spark, sf):
    """What verdicts on types do: a correction has to be sure and name a registered type."""
    n = names(spark, sf)
    verdict = F.element_at(F.array(F.lit("confirm"), F.lit("correct"), F.lit("uncertain")), (F.col("id") % 3 + 1).cast("int"))
    return n.select("id", gates.verdict_action(verdict, F.col("id") % 13, (F.col("id") % 10) / 10, F.col("id") % 13 < 10).alias("action"))


def contradiction_labels(spark, sf):
    """Facts of a key against the newest one: contradicted where the object differs, a duplicate where not, from which pool."""
    key = Window.partitionBy("subject_id", "predicate")
    f = facts(spark, sf).filter("expired_at is null").withColumn("new", F.max(F.struct("valid_from", "id", "object_value")).over(key)).filter("id <> new.id")
    same = F.col("object_value") == F.col("new.object_value")
    one = lambda hit: F.when(hit, F.array("id")).otherwise(F.array().cast("array<bigint>"))
    pool = F.when(F.col("id") % 2 == 0, "subject-predicate").otherwise("shared-entity")
    return f.select("id", gates.contradiction_label(F.col("id"), pool, one(~same), one(same)).alias("label"))


def policy_lookups(spark, sf):
    """Facts whose namespace refuses what would expire them."""
    policy = spark.createDataFrame([("g0", "AppendOnly"), ("g1", "Mutable"), ("g2", "Mutable")], "group_id string, policy string")
    f = facts(spark, sf).join(F.broadcast(policy), "group_id", "left")
    return f.groupBy("group_id").agg(F.count_if(F.coalesce(mutate.blocked(F.col("policy")), F.lit(False))).alias("refused"), F.count("*").alias("n"))


def forgotten_namespaces(spark, sf):
    """Facts left when two namespaces are to be forgotten, one of which only appends."""
    asked = spark.createDataFrame([("g0", "AppendOnly"), ("g1", "Mutable")], "group_id string, policy string")
    gone = asked.filter(~mutate.blocked(F.col("policy"))).select("group_id")
    return facts(spark, sf).join(F.broadcast(gone), "group_id", "left_anti").groupBy("group_id").agg(F.count("*").alias("n"))


def bfs_asof_capped(spark, sf):
    """Two hops on edges valid by an instant, the nearest eight of each seed."""
    live = edges(spark, sf).filter(F.col("active") & (F.col("valid_from") <= F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")))
    return graph.expand(ends(live), seeds(spark, ["p:7", "s:3"]), 2, cap=8)


def reachable_chain(spark, sf):
    """All parts below part 1 where each hangs under the part of half its number: many hops, not one."""
    p = raw(spark, sf, "part").filter("p_partkey > 1").select(F.floor(F.col("p_partkey") / 2).alias("subject_id"), F.col("p_partkey").alias("object_id"))
    return graph.reachable(graph.undirected(p), spark.createDataFrame([(1,)], "node long")).select("node")


def deep_components(spark, sf):
    """Parts in three trees that hang ever deeper: components that a single hop does not show."""
    p = raw(spark, sf, "part").filter("p_partkey > 3").select(F.floor(F.col("p_partkey") / 2).alias("subject_id"), F.col("p_partkey").alias("object_id"))
    return graph.components(graph.undirected(p))


TYPES = f"t AS (SELECT name AS n, count(*) AS c, {SHG.format('name')} AS s FROM names GROUP BY name)"
LIVE_KEYS = "m AS (SELECT *, last_value(id) OVER w AS nid, last_value(object_value) OVER w AS nv FROM facts WHERE expired_at IS NULL WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
QUERIES = {
    "bfs_asof_capped": (bfs_asof_capped, with_sql(EDGES_SQL, *hops(["p:7", "s:3"], EARLY, 2), body="SELECT seed, node, depth FROM h2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node) <= 8")),
    "maximal_cliques": (maximal_cliques, None),
    "cross_episode_merges": (cross_episode_merges, None),
    "persisted_communities": (persisted_communities, with_sql(NAMES_SQL, body="SELECT group_id, count(*) AS members, bool_or(id % 97 = 5) AS changed FROM names GROUP BY group_id")),
    "live_facts": (live_facts, with_sql(FACTS_SQL, body="SELECT group_id, count(*) FILTER (WHERE expired_at IS NULL) AS live FROM facts GROUP BY group_id")),
    "endpoint_live_facts": (endpoint_live_facts, with_sql(EDGES_SQL, body="SELECT id, CAST(sum(live) AS BIGINT) AS live FROM (SELECT subject_id AS id, CASE WHEN active THEN 1 ELSE 0 END AS live FROM edges UNION ALL SELECT object_id, CASE WHEN active THEN 1 ELSE 0 END FROM edges) GROUP BY id")),
    "assertion_sets": (assertion_sets, with_sql(FACTS_SQL, "k AS (SELECT DISTINCT subject_id, predicate || '␟' || object_value AS k FROM facts WHERE expired_at IS NULL)", body="SELECT subject_id, sha256(string_agg(k, '|' ORDER BY k)) AS keys FROM k GROUP BY subject_id")),
    "canonical_merges": (canonical_merges, "WITH RECURSIVE " + ", ".join([NAMES_SQL, NAME_PAIRS, "s AS (SELECT CASE WHEN length(y.name) > length(x.name) THEN b ELSE a END AS keeper, CASE WHEN length(y.name) > length(x.name) THEN a ELSE b END AS loser, greatest(length(x.name), length(y.name)) AS n FROM np JOIN names x ON x.id = a JOIN names y ON y.id = b)", "k AS (SELECT loser, keeper FROM s QUALIFY row_number() OVER (PARTITION BY loser ORDER BY n DESC, keeper) = 1)", "c(loser, keeper, d) AS (SELECT loser, keeper, 0 FROM k UNION ALL SELECT c.loser, k.keeper, d + 1 FROM c JOIN k ON k.loser = c.keeper WHERE d < 64)"]) + " SELECT loser, arg_max(keeper, d) AS keeper FROM c GROUP BY loser"),
    "acronym_nominations": (acronym_nominations, "WITH m AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS x FROM lineitem) SELECT a.x AS a, b.x AS b, count(*) AS weight FROM m a JOIN m b USING (e) JOIN part p ON p.p_partkey = a.x JOIN part q ON q.p_partkey = b.x AND q.p_brand = p.p_brand WHERE a.x < b.x AND (a.x + b.x) % 4 <> 0 GROUP BY 1, 2"),
    "type_collapse_keepers": (type_collapse_keepers, with_sql(NAMES_SQL, TYPES, "p AS (SELECT x.n AS a, y.n AS b, x.c AS ca, y.c AS cb, strlen(x.n) - strlen(y.n) AS gap FROM t x JOIN t y ON x.n < y.n WHERE len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(list_concat(x.s, y.s))) > 0.3)", body="SELECT a, b, CASE WHEN CASE WHEN abs(gap) <= 5 THEN CASE WHEN ca <> cb THEN ca > cb ELSE gap >= 0 END ELSE gap > 0 END THEN a ELSE b END AS keeper FROM p")),
    "retype_evidence": (retype_evidence, with_sql(VECTORS_SQL, "s AS (SELECT id, entity_type_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE id = 0)), 6) AS score FROM vectors)", body="SELECT id, CASE WHEN round(score + 0.55, 6) >= 0.75 THEN 11 ELSE 0 END AS entity_type_id FROM s WHERE entity_type_id = 0")),
    "consistency_candidates": (consistency_candidates, with_sql(FACTS_SQL, "k AS (SELECT subject_id, source_episode_id, predicate || ' ' || object_value AS f, row_number() OVER (PARTITION BY subject_id ORDER BY recorded_at DESC, id DESC) AS k FROM facts WHERE CAST(substring(subject_id, 3) AS BIGINT) % 5 <> 0)", body="SELECT subject_id, string_agg(f, '; ' ORDER BY k) AS facts, arg_min(source_episode_id, k) AS episode FROM k WHERE k <= 3 GROUP BY subject_id")),
    "verified_types": (verified_types, with_sql(NAMES_SQL, body="SELECT id, CASE WHEN id % 3 = 0 THEN 'Confirm' WHEN id % 3 = 1 AND (id % 10) / 10.0::DOUBLE >= 0.7 AND id % 13 < 10 AND id % 13 > 0 THEN 'Correct' ELSE 'Demote' END AS action FROM names")),
    "contradiction_labels": (contradiction_labels, with_sql(FACTS_SQL, LIVE_KEYS, body="SELECT id, CASE WHEN object_value = nv THEN 'duplicate' ELSE 'contradicted' END || ':' || CASE WHEN id % 2 = 0 THEN 'subject-predicate' ELSE 'shared-entity' END AS label FROM m WHERE id <> nid")),
    "policy_lookups": (policy_lookups, with_sql(FACTS_SQL, body="SELECT group_id, CASE WHEN group_id = 'g0' THEN count(*) ELSE 0 END AS refused, count(*) AS n FROM facts GROUP BY group_id")),
    "forgotten_namespaces": (forgotten_namespaces, with_sql(FACTS_SQL, body="SELECT group_id, count(*) AS n FROM facts WHERE group_id <> 'g1' GROUP BY group_id")),
    "reachable_chain": (reachable_chain, "WITH RECURSIVE r(node) AS (SELECT CAST(1 AS BIGINT) UNION SELECT p_partkey FROM part JOIN r ON p_partkey // 2 = node WHERE p_partkey > 1) SELECT node FROM r"),
    "deep_components": (deep_components, "WITH RECURSIVE r(node, up) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey > 3 UNION ALL SELECT node, up // 2 FROM r WHERE up > 3) SELECT node, min(up) AS component FROM r GROUP BY node UNION ALL SELECT DISTINCT p_partkey // 2, p_partkey // 2 FROM part WHERE p_partkey > 3 AND p_partkey // 2 <= 3"),
}
