"""Entity resolution, consolidation and integrity as batch passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.functions import scoring, text
from tempograph.functions.vector import cosine
from tempograph.operators import graph, mutate, resolve
from tempograph.sources.adapters import EDGES_SQL, EPISODES_SQL, FACTS_SQL, NAMES_SQL, VECTORS_SQL, edges, episodes, facts, names, raw, vectors, with_sql

CUT = 0.2
MERGE, ALIAS = 0.5, 0.3


def allpairs_cosine(spark, sf):
    return resolve.similar_pairs(vectors(spark, sf), CUT)


def classify_pair_ladder(spark, sf):
    from tempograph.config import Config

    v = vectors(spark, sf).select("id", "entity_type_id")
    p = allpairs_cosine(spark, sf)
    both = p.join(v.withColumnRenamed("id", "a").withColumnRenamed("entity_type_id", "ta"), "a").join(v.withColumnRenamed("id", "b").withColumnRenamed("entity_type_id", "tb"), "b")
    return both.select("a", "b", resolve.classify(F.col("score"), F.col("ta") == F.col("tb"), (F.col("a") + F.col("b")) % 3 != 0, Config(merge_cosine=MERGE, alias_cosine=ALIAS)).alias("decision"))


def write_gate_table(spark, sf):
    """Every row of the table, met by events."""
    e = raw(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    proposed = F.when(F.col("k") % 2 == 0, "Merge").otherwise("PotentialAlias")
    same = F.when(F.col("k") % 5 == 0, F.lit(None).cast("boolean")).otherwise(F.col("k") % 5 > 1)
    return e.select("event_id", resolve.write_gate(F.col("k") % 7 == 0, proposed, same, F.col("k") / 100).alias("decision"))


def alias_resolution(spark, sf):
    p = allpairs_cosine(spark, sf)
    from tempograph.config import Config

    return p.select("a", "b", resolve.alias_outcome(F.col("score"), (F.col("a") + F.col("b")) % 2 == 0, Config(merge_cosine=MERGE, revoke_cosine=ALIAS)).alias("outcome"))


def blocking_candidates(spark, sf):
    """The three nearest of each vector, or those of its type."""
    v = vectors(spark, sf)
    return resolve.all_nearest(v, v, 3, CUT).select("id", "other_id", "rank")


def name_match_pairs(spark, sf):
    return resolve.name_pairs(names(spark, sf))


def canonicalize_keeper(spark, sf):
    """Of each pair the longer name is kept, ties to the earlier id."""
    n = names(spark, sf).select("id", F.length("name").alias("n"))
    p = resolve.name_pairs(names(spark, sf))
    both = p.join(n.withColumnRenamed("id", "a").withColumnRenamed("n", "na"), "a").join(n.withColumnRenamed("id", "b").withColumnRenamed("n", "nb"), "b")
    return both.select("a", "b", F.when(F.col("nb") > F.col("na"), F.col("b")).otherwise(F.col("a")).alias("keeper"))


def corroboration_weight(spark, sf):
    f = edges(spark, sf).groupBy("subject_id").agg(F.countDistinct("object_id").alias("frequency"))
    return f.select("subject_id", "frequency", resolve.corroboration(F.col("frequency")).alias("weight"))


def assertion_frequency(spark, sf):
    return facts(spark, sf).filter("expired_at is null").groupBy("predicate", "object_value").agg(F.countDistinct("subject_id").alias("subjects"))


def merge_repoint(spark, sf):
    """Suppliers of one nation become one; the facts that follow."""
    s = raw(spark, sf, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), "s_suppkey", "s_nationkey")
    keeper = s.groupBy("s_nationkey").agg(F.concat(F.lit("s:"), F.min("s_suppkey").cast("string")).alias("keeper"))
    merged = s.join(keeper, "s_nationkey").filter("id <> keeper").select(F.col("id").alias("loser"), "keeper")
    after = resolve.repoint(edges(spark, sf).select("subject_id", "object_id", "episode_id"), merged)
    return after.groupBy("object_id").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("subjects"))


def type_collapse_pairs(spark, sf):
    types = names(spark, sf).select("type_name").distinct()
    a, b = types.select(F.col("type_name").alias("a")), types.select(F.col("type_name").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).filter(text.jaccard(text.char_shingles(F.col("a")), text.char_shingles(F.col("b"))) > 0.3).select("a", "b")


def archive_split(spark, sf):
    f = mutate.archived(facts(spark, sf), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    return f.groupBy("group_id").agg(F.sum(F.col("archive").cast("long")).alias("archived"), F.sum((~F.col("archive")).cast("long")).alias("kept"))


def interlock(spark, sf):
    f = facts(spark, sf).groupBy("group_id").agg(F.sum(F.col("expired_at").isNull().cast("long")).alias("live"), F.sum((F.col("predicate") == "error").cast("long")).alias("candidates"))
    return f.select("group_id", "live", "candidates", scoring.decide_bulk(F.col("candidates"), F.col("live")).alias("decision"))


def community_labels(spark, sf):
    """The three commonest types of each brand."""
    from pyspark.sql import Window

    n = names(spark, sf).groupBy("group_id", "type_name").agg(F.count("*").alias("n"))
    order = Window.partitionBy("group_id").orderBy(F.col("n").desc(), "type_name")
    top = n.withColumn("k", F.row_number().over(order)).filter("k <= 3")
    return top.groupBy("group_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "type_name"))), lambda x: x.type_name), "|").alias("labels"))


def member_hash(spark, sf):
    n = names(spark, sf).select("group_id", F.lpad(F.col("id").cast("string"), 9, "0").alias("id"))
    return n.groupBy("group_id").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("id"))), 256).alias("hash"), F.count("*").alias("members"))


def reclassify_candidates(spark, sf):
    v = vectors(spark, sf).withColumn("confidence", (F.col("id") % 100) / 100)
    return v.filter((F.col("entity_type_id") == 0) | (F.col("confidence") < 0.3)).orderBy("id").limit(100).select("id", "entity_type_id", F.when(F.col("confidence") >= 0.9, "stamped").otherwise("changed").alias("outcome"))


def exclusion_counts(spark, sf):
    return facts(spark, sf).groupBy("group_id").agg(F.count_if(F.col("confidence") >= 0.9).alias("pinned"), F.count_if(F.col("expired_at").isNotNull()).alias("expired"), F.count("*").alias("n"))


def within_episode_multivalue(spark, sf):
    g = facts(spark, sf).groupBy("source_episode_id", "predicate").agg(F.countDistinct("object_value").alias("values"), F.count("*").alias("n"))
    return g.filter("n > 1").select("source_episode_id", "predicate", "values", (F.col("n") - F.col("values")).alias("repeated"))


def forget_by_source(spark, sf):
    m = edges(spark, sf).select(F.col("subject_id").alias("entity_id"), F.concat(F.lit("src"), (F.col("episode_id") % 50).cast("string")).alias("source_id"))
    return mutate.forgettable(m, "src7")


def nogood_exclusion(spark, sf):
    p = allpairs_cosine(spark, sf)
    never = p.filter("(a + b) % 4 = 0").select("a", "b")
    return p.join(never, ["a", "b"], "left_anti")


def orphan_nodes(spark, sf):
    used = edges(spark, sf).select(F.expr("cast(substring(subject_id, 3) as bigint)").alias("id")).distinct()
    return names(spark, sf).select("id").join(used, "id", "left_anti")


def duplicate_edges(spark, sf):
    d = edges(spark, sf).filter("active").groupBy("subject_id", "object_id", "predicate").agg(F.count("*").alias("n"))
    return d.filter("n > 1")


def merge_chain_fanin(spark, sf):
    m = raw(spark, sf, "orders").select(F.col("o_custkey").alias("keeper"), F.col("o_orderkey").alias("loser"))
    return m.groupBy("keeper").agg(F.countDistinct("loser").alias("losers")).filter("losers >= 12")


def cluster_names(spark, sf):
    n = names(spark, sf).select(F.lower(F.trim("name")).alias("name"))
    return n.groupBy("name").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name").limit(20)


def contradiction_pool(spark, sf):
    """Active facts of the same subject and predicate whose window meets that of the newest one, by whether they say the same."""
    from pyspark.sql import Window

    from tempograph.functions.temporal import overlaps

    f = facts(spark, sf).filter("expired_at is null")
    newest = f.withColumn("new", F.max(F.struct("valid_from", "id", "object_value")).over(Window.partitionBy("subject_id", "predicate"))).filter("id <> new.id")
    pool = newest.filter(overlaps(F.col("valid_from"), F.col("valid_to"), F.expr("new.valid_from - interval 2 days"), F.lit(None).cast("timestamp_ntz")))
    return pool.select("id", F.when(F.col("object_value") == F.col("new.object_value"), "duplicate").otherwise("conflict").alias("pool"))


def merge_components(spark, sf):
    """Components of pairs above a cosine, not over 32 wide, each with its least member."""
    c = resolve.near_components(vectors(spark, sf), MERGE)
    size = c.groupBy("component").agg(F.count("*").alias("n")).filter("n <= 32")
    return c.join(size, "component").select("node", "component", "n")


def namespace_policy(spark, sf):
    n = raw(spark, sf, "nation").select(F.col("n_name").alias("group_id"), F.when(F.col("n_regionkey") == 0, "AppendOnly").otherwise("Mutable").alias("policy"))
    return n.select("group_id", "policy", (~mutate.blocked(F.col("policy"))).alias("forgettable"))


def label_join(spark, sf):
    v, types = vectors(spark, sf), spark.createDataFrame([(i, f"Type{i}") for i in range(8)], "t int, name string")
    return v.join(F.broadcast(types), F.col("entity_type_id") == F.col("t"), "left").select("id", F.coalesce("name", F.lit("Entity")).alias("label"))


def pair_cosine_of_neighbours(spark, sf):
    """Cosine of each vector with the next one of its namespace."""
    from pyspark.sql import Window

    v = vectors(spark, sf).withColumn("next", F.lead("embedding").over(Window.partitionBy("group_id").orderBy("id"))).filter("next is not null")
    return v.select("id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("score"))


def episode_grouping(spark, sf):
    return episodes(spark, sf).groupBy("group_id", "source_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("timestamp").alias("last_seen"))


PAIRS = f"p AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS score, x.entity_type_id AS ta, y.entity_type_id AS tb FROM vectors x JOIN vectors y ON x.id < y.id), pairs AS (SELECT * FROM p WHERE score > {CUT})"
NAME_PAIRS = "l AS (SELECT DISTINCT trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS label FROM names), f AS (SELECT trim(regexp_replace(lower(name), '\\s+', ' ', 'g')) AS label, min(id) AS id FROM names GROUP BY 1), w AS (SELECT label, list_distinct(list_filter(list_transform(regexp_split_to_array(label, '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}_]', '', 'g')), lambda w: w <> '')) AS w FROM l), np AS (SELECT f.id AS a, n.id AS b FROM f JOIN names n ON trim(regexp_replace(lower(n.name), '\\s+', ' ', 'g')) = f.label AND n.id <> f.id UNION SELECT least(fx.id, fy.id), greatest(fx.id, fy.id) FROM w x JOIN w y ON x.label < y.label JOIN f fx ON fx.label = x.label JOIN f fy ON fy.label = y.label WHERE len(x.w) > 0 AND len(y.w) > 0 AND len(list_intersect(x.w, y.w))::DOUBLE / len(list_distinct(list_concat(x.w, y.w))) >= 0.9)"
SHG = "CASE WHEN length({0}) >= 3 THEN list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substring({0}, i, 3))) ELSE [{0}] END"

COMPONENTS_SQL = "WITH RECURSIVE " + ", ".join([VECTORS_SQL, PAIRS, f"g AS (SELECT a AS x, b AS y FROM pairs WHERE score > {MERGE} UNION SELECT b, a FROM pairs WHERE score > {MERGE})", "reach(x, y) AS (SELECT x, y FROM g UNION SELECT r.x, g.y FROM reach r JOIN g ON g.x = r.y)", "c AS (SELECT x AS node, least(x, min(y)) AS component FROM reach GROUP BY x)"]) + " SELECT node, component, n FROM c JOIN (SELECT component, count(*) AS n FROM c GROUP BY component) USING (component) WHERE n <= 32"

QUERIES = {
    "allpairs_cosine": (allpairs_cosine, with_sql(VECTORS_SQL, PAIRS, body="SELECT a, b, score FROM pairs")),
    "classify_pair_ladder": (classify_pair_ladder, with_sql(VECTORS_SQL, PAIRS, body=f"SELECT a, b, CASE WHEN score >= {MERGE} AND ta = tb THEN CASE WHEN (a + b) % 3 <> 0 THEN 'Merge' ELSE 'PotentialAlias' END WHEN score >= {ALIAS} AND ta = tb THEN 'PotentialAlias' ELSE 'New' END AS decision FROM pairs")),
    "write_gate_table": (write_gate_table, "WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) SELECT event_id, CASE WHEN k % 7 = 0 THEN 'Reject' WHEN k % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'Merge' ELSE 'PotentialAlias' END WHEN k % 5 <= 1 THEN 'Reject' WHEN k / 100.0 < 0.7 THEN 'PotentialAlias' ELSE 'Merge' END AS decision FROM e"),
    "alias_resolution": (alias_resolution, with_sql(VECTORS_SQL, PAIRS, body=f"SELECT a, b, CASE WHEN score >= {MERGE} AND (a + b) % 2 = 0 THEN 'resolved' WHEN score >= {MERGE} OR score < {ALIAS} THEN 'revoked' ELSE 'kept' END AS outcome FROM pairs")),
    "blocking_candidates": (blocking_candidates, with_sql(VECTORS_SQL, PAIRS, "u AS (SELECT a AS id, b AS other_id, score FROM pairs UNION ALL SELECT b, a, score FROM pairs)", body="SELECT id, other_id, CAST(row_number() OVER w AS BIGINT) AS rank FROM u WINDOW w AS (PARTITION BY id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 3")),
    "name_match_pairs": (name_match_pairs, with_sql(NAMES_SQL, NAME_PAIRS, body="SELECT a, b FROM np")),
    "canonicalize_keeper": (canonicalize_keeper, with_sql(NAMES_SQL, NAME_PAIRS, body="SELECT a, b, CASE WHEN length(y.name) > length(x.name) THEN b ELSE a END AS keeper FROM np JOIN names x ON x.id = a JOIN names y ON y.id = b")),
    "corroboration_weight": (corroboration_weight, with_sql(EDGES_SQL, "f AS (SELECT subject_id, count(DISTINCT object_id) AS frequency FROM edges GROUP BY subject_id)", body="SELECT subject_id, frequency, CAST(CASE WHEN frequency <= 8 THEN round(1048576.0 / (1 + log2(frequency))) ELSE 0 END AS BIGINT) AS weight FROM f")),
    "assertion_frequency": (assertion_frequency, with_sql(FACTS_SQL, body="SELECT predicate, object_value, count(DISTINCT subject_id) AS subjects FROM facts WHERE expired_at IS NULL GROUP BY 1, 2")),
    "merge_repoint": (merge_repoint, with_sql(EDGES_SQL, "k AS (SELECT 's:' || s_suppkey AS id, 's:' || min(s_suppkey) OVER (PARTITION BY s_nationkey) AS keeper FROM supplier)", body="SELECT keeper AS object_id, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM edges JOIN k ON k.id = object_id GROUP BY keeper")),
    "type_collapse_pairs": (type_collapse_pairs, with_sql(NAMES_SQL, f"t AS (SELECT DISTINCT type_name AS n, {SHG.format('type_name')} AS s FROM names)", body="SELECT x.n AS a, y.n AS b FROM t x JOIN t y ON x.n < y.n WHERE len(list_intersect(x.s, y.s))::DOUBLE / len(list_distinct(list_concat(x.s, y.s))) > 0.3")),
    "archive_split": (archive_split, with_sql(FACTS_SQL, "l AS (SELECT *, sum(CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id) AS live FROM facts)", body="SELECT group_id, CAST(sum(CASE WHEN expired_at < TIMESTAMP '2024-01-25 00:00:00' AND live > 0 THEN 1 ELSE 0 END) AS BIGINT) AS archived, CAST(sum(CASE WHEN expired_at < TIMESTAMP '2024-01-25 00:00:00' AND live > 0 THEN 0 ELSE 1 END) AS BIGINT) AS kept FROM l GROUP BY group_id")),
    "interlock": (interlock, with_sql(FACTS_SQL, "s AS (SELECT group_id, CAST(sum(CASE WHEN expired_at IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS live, CAST(sum(CASE WHEN predicate = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS candidates FROM facts GROUP BY group_id)", body="SELECT group_id, live, candidates, CASE WHEN candidates > 0 AND live >= 20 AND candidates / live > 0.25 THEN 'Blocked' ELSE 'Allowed' END AS decision FROM s")),
    "community_labels": (community_labels, with_sql(NAMES_SQL, "n AS (SELECT group_id, type_name, count(*) AS n FROM names GROUP BY 1, 2)", "k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, type_name) AS k FROM n)", body="SELECT group_id, string_agg(type_name, '|' ORDER BY k) AS labels FROM k WHERE k <= 3 GROUP BY group_id")),
    "member_hash": (member_hash, with_sql(NAMES_SQL, body="SELECT group_id, sha256(string_agg(lpad(CAST(id AS VARCHAR), 9, '0'), '|' ORDER BY id)) AS hash, count(*) AS members FROM names GROUP BY group_id")),
    "reclassify_candidates": (reclassify_candidates, with_sql(VECTORS_SQL, body="SELECT id, entity_type_id, CASE WHEN (id % 100) / 100.0 >= 0.9 THEN 'stamped' ELSE 'changed' END AS outcome FROM vectors WHERE entity_type_id = 0 OR (id % 100) / 100.0 < 0.3 ORDER BY id LIMIT 100")),
    "exclusion_counts": (exclusion_counts, with_sql(FACTS_SQL, body="SELECT group_id, count(*) FILTER (WHERE confidence >= 0.9) AS pinned, count(*) FILTER (WHERE expired_at IS NOT NULL) AS expired, count(*) AS n FROM facts GROUP BY group_id")),
    "within_episode_multivalue": (within_episode_multivalue, with_sql(FACTS_SQL, body="SELECT source_episode_id, predicate, count(DISTINCT object_value) AS values, count(*) - count(DISTINCT object_value) AS repeated FROM facts GROUP BY 1, 2 HAVING count(*) > 1")),
    "forget_by_source": (forget_by_source, with_sql(EDGES_SQL, body="SELECT subject_id AS entity_id FROM edges GROUP BY subject_id HAVING bool_and(episode_id % 50 = 7)")),
    "nogood_exclusion": (nogood_exclusion, with_sql(VECTORS_SQL, PAIRS, body="SELECT a, b, score FROM pairs WHERE (a + b) % 4 <> 0")),
    "orphan_nodes": (orphan_nodes, "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)"),
    "duplicate_edges": (duplicate_edges, with_sql(EDGES_SQL, body="SELECT subject_id, object_id, predicate, count(*) AS n FROM edges WHERE active GROUP BY 1, 2, 3 HAVING count(*) > 1")),
    "merge_chain_fanin": (merge_chain_fanin, "SELECT o_custkey AS keeper, count(DISTINCT o_orderkey) AS losers FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey) >= 12"),
    "cluster_names": (cluster_names, with_sql(NAMES_SQL, body="SELECT lower(trim(name)) AS name, count(*) AS n FROM names GROUP BY 1 ORDER BY n DESC, name LIMIT 20")),
    "contradiction_pool": (contradiction_pool, with_sql(FACTS_SQL, "f AS (SELECT * FROM facts WHERE expired_at IS NULL)", "m AS (SELECT *, last_value(id) OVER w AS nid, last_value(object_value) OVER w AS nv, last_value(valid_from) OVER w AS nf FROM f WINDOW w AS (PARTITION BY subject_id, predicate ORDER BY valid_from, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", body="SELECT id, CASE WHEN object_value = nv THEN 'duplicate' ELSE 'conflict' END AS pool FROM m WHERE id <> nid AND nf - INTERVAL 2 DAYS < coalesce(valid_to, TIMESTAMP '9999-12-31 00:00:00')")),
    "merge_components": (merge_components, COMPONENTS_SQL),
    "namespace_policy": (namespace_policy, "SELECT n_name AS group_id, CASE WHEN n_regionkey = 0 THEN 'AppendOnly' ELSE 'Mutable' END AS policy, n_regionkey <> 0 AS forgettable FROM nation"),
    "label_join": (label_join, with_sql(VECTORS_SQL, body="SELECT id, CASE WHEN entity_type_id < 8 THEN 'Type' || entity_type_id ELSE 'Entity' END AS label FROM vectors")),
    "pair_cosine_of_neighbours": (pair_cosine_of_neighbours, with_sql(VECTORS_SQL, "n AS (SELECT id, embedding, lead(embedding) OVER (PARTITION BY group_id ORDER BY id) AS nx FROM vectors)", body="SELECT id, round(list_cosine_similarity(embedding, nx), 6) AS score FROM n WHERE nx IS NOT NULL")),
    "episode_grouping": (episode_grouping, with_sql(EPISODES_SQL, body="SELECT group_id, source_id, count(*) AS n, min(id) AS first_id, max(timestamp) AS last_seen FROM episodes GROUP BY 1, 2")),
}
