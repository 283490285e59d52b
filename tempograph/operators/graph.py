"""Graph operators as iterated joins; every round is cut from its lineage by a reliable checkpoint."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of this machine only where all runs on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder of the session.

    Spark's own takes over the plan's estimate of bytes, and a join multiplies
    those of its sides: in a loop the number doubles its digits every round,
    until the driver's memory is full.  Beyond a long it is left out.
    """
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    held = df.checkpoint()
    plan = held._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < 2**63:
        return held
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), held._jdf.schema(), False), spark)


def undirected(edges: DataFrame, a: str = "subject_id", b: str = "object_id") -> DataFrame:
    """Both directions of each edge, once."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def expand(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes within so many hops of (src, dst) edges, taken both ways; with a cap, the nearest of each seed by depth and id.

    Each hop reads only the edges at the frontier: the frontier joins both
    ends of the edges, so no undirected copy of the graph is made.
    """
    reached = kept(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")))
    front = reached
    for depth in range(1, hops + 1):
        out = front.join(edges, front.node == edges.src).select("seed", F.col("dst").alias("node"))
        back = front.join(edges, front.node == edges.dst).select("seed", F.col("src").alias("node"))
        step = out.union(back).distinct().join(reached, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:
            front = kept(step)
            reached = reached.unionByName(front)
        else:
            reached = reached.unionByName(step)
    if cap is not None:
        place = F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))
        reached = reached.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")
    return reached


def reachable(links: DataFrame, seeds: DataFrame, most: int = 32) -> DataFrame:
    """Everything connected to each seed, up to a depth."""
    reached = kept(seeds.select(F.col("node").alias("seed"), "node"))
    front = reached
    for _ in range(most):
        step = front.join(links, front.node == links.src).select("seed", F.col("dst").alias("node")).distinct()
        front = kept(step.join(reached, ["seed", "node"], "left_anti"))
        if front.isEmpty():
            break
        reached = kept(reached.union(front))
    return reached


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each one is connected to.

    Each round takes the least label of the neighbours, gives it also to the
    node that is the label so far, and then takes the label's own label.  On
    paths, in whatever order their nodes come, rounds grow with the logarithm.
    """
    labels = kept(links.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node")))
    state = None
    while True:
        near = links.join(labels, links.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        met = labels.join(near, labels.node == near.src).select("node", "component", F.least("component", "near").alias("near"))
        hook = met.groupBy(F.col("component").alias("_root")).agg(F.min("near").alias("hook"))
        step = met.join(hook, met.node == hook._root, "left").select("node", F.least("near", "hook").alias("component"))
        jump = step.select(F.col("node").alias("_node"), F.col("component").alias("_next"))
        labels = kept(step.join(jump, step.component == jump._node, "left").select("node", F.least("component", F.coalesce("_next", "component")).alias("component")))
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return labels
        state = now


def pagerank(links: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) after so many rounds; nodes without links out do not exist in an undirected view."""
    degree = links.groupBy("src").agg(F.count("*").alias("out"))
    weighted = kept(links.join(degree, "src").select("src", "dst", "out"))
    n = degree.count()
    ranks = degree.select(F.col("src").alias("node"), F.lit(1.0 / max(n, 1)).alias("rank"))
    for k in range(rounds):
        given = weighted.join(ranks, weighted.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        ranks = given.select(F.col("dst").alias("node"), (F.lit((1 - damping) / max(n, 1)) + F.lit(damping) * F.col("got")).alias("rank"))
        if k % 5 == 4:
            ranks = kept(ranks)
    return ranks


def label_propagation(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label): each node takes its neighbours' most frequent label, ties to the least, its own if that is among them.

    Nodes take turns by the parity of their hash, as neighbours that change at
    once can swap labels for ever.
    """
    labels = kept(links.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    still = 0
    for k in range(rounds):
        turn = links.filter(F.pmod(F.xxhash64("src"), F.lit(2)) == k % 2)
        votes = turn.join(labels, turn.dst == labels.node).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.max("n").alias("most"))
        top = votes.join(best, "src").filter("n = most").groupBy("src").agg(F.min("label").alias("least"), F.collect_set("label").alias("tied"))
        taken = F.when(F.col("least").isNull() | F.array_contains("tied", F.col("label")), F.col("label")).otherwise(F.col("least"))
        following = kept(labels.join(top, labels.node == top.src, "left").select("node", taken.alias("label"), F.col("label").alias("old")))
        still = 0 if following.filter("label <> old").limit(1).count() else still + 1
        labels = following.select("node", "label")
        if still == 2:
            break
    return labels


def pairs_within(members: DataFrame, group: str, member: str, widest: int = 1000) -> DataFrame:
    """(a, b, group) of all members of the same group, a < b.

    A group of m members has m (m - 1) / 2 pairs, which are the result.  Groups
    of up to ``widest`` members are joined in one piece.  The members of a
    wider one are dealt by hash into cells of about ``widest``, and each pair
    of cells is a key of its own: no task holds the group, and each member is
    sent to as many tasks as the group has cells.
    """
    own = members.select(F.col(group).alias("g"), F.col(member).alias("x")).distinct()
    cells = own.groupBy("g").agg(F.ceil(F.count("*") / widest).cast("int").alias("cells"))
    sized = own.join(cells, "g").withColumn("cell", F.pmod(F.xxhash64("x"), F.col("cells")).cast("int"))
    sent = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    sent = sent.select("g", "x", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high"))
    left, right = sent.withColumnRenamed("x", "a").withColumnRenamed("cell", "ca"), sent.withColumnRenamed("x", "b").withColumnRenamed("cell", "cb")
    both = left.join(right, ["g", "low", "high"]).filter("a < b")
    # a pair inside one cell belongs to that cell alone
    return both.filter("ca <> cb or low = high").select("a", "b", "g")


def cooccurrence(mentions: DataFrame, episode: str = "episode_id", entity: str = "entity_id", widest: int = 1000) -> DataFrame:
    """(a, b, weight): entities mentioned in the same episodes, a < b; wide episodes are spread as in ``pairs_within``."""
    return pairs_within(mentions, episode, entity, widest).groupBy("a", "b").agg(F.count("*").alias("weight"))


def shared_neighbours(links: DataFrame, widest: int = 1000) -> DataFrame:
    """(a, b, shared): pairs of nodes with common neighbours, a < b; hubs are spread as in ``pairs_within``."""
    return pairs_within(links, "dst", "src", widest).groupBy("a", "b").agg(F.count("*").alias("shared"))


def degree(links: DataFrame) -> DataFrame:
    return links.groupBy("src").agg(F.countDistinct("dst").alias("degree")).withColumnRenamed("src", "node")


def survivors(merged: DataFrame, most: int = 64) -> DataFrame:
    """(loser, keeper) with chains of keepers followed to their end, by pointer jumping."""
    current = kept(merged.select("loser", "keeper"))
    for _ in range(max(1, most.bit_length())):
        onward = current.select(F.col("loser").alias("_k"), F.col("keeper").alias("_next"))
        current = kept(current.join(onward, current.keeper == onward._k, "left").select("loser", F.coalesce("_next", "keeper").alias("keeper")))
    return current


def maximal_cliques(nodes: list, adjacent: dict) -> list[tuple]:
    """Maximal cliques of a small component in a fixed order (the caller bounds its size)."""
    found, todo = [], [((), tuple(sorted(nodes)), ())]
    while todo:
        held, open_, closed = todo.pop()
        if not open_ and not closed:
            found.append(tuple(sorted(held)))
            continue
        if not open_:
            continue
        pivot = min(open_ + closed)
        skipped = adjacent[pivot]
        later, past = list(open_), list(closed)
        for v in [x for x in open_ if x not in skipped]:
            todo.append(((*held, v), tuple(x for x in later if x in adjacent[v]), tuple(x for x in past if x in adjacent[v])))
            later.remove(v)
            past.append(v)
    return sorted(c for c in found if len(c) > 1)
