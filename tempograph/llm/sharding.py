"""Shards by balanced label propagation, in DataFrame functions alone.

Documents are linked where their texts are equal.  Linked documents start in
the shard of their id's hash; in each round every group's smaller fragments ask
for the shard where most of the group is, of those with room if it has any
there.  How
many of those that ask to go from one shard to another may go is worked out on
the table of their counts (shards squared), so that what enters a shard is no
more than its room and what leaves it; those that gain most go first.
Documents without links fill what is left, so the counts of any two shards
differ by one at most (the law ``rows``).

The graph is kept as groups, never as pairs: a group has at most one fragment
per shard, however many copies it has, so one text that holds a third of all
rows moves as a few rows and is split over the shards it needs.  Rows of groups
that hold more than a thousandth of all rows, of which there are fewer than a
thousand, meet what is known of their group by a broadcast; so no task reads
more than a thousandth of the rows for one group.

Null texts count as empty (size 1), null ids are hashed like any other, equal
rows are kept each, an empty table gives an empty result, and extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, running, whole_text


#: Groups of more than one in so many rows are met by broadcast.
HOT = 1000
#: What slots are ordered by inside a bucket; rows alike in all of it give the same rows.
ORDER = ("doc_id", "text_crc32", "size")


def shard(df: DataFrame, shards: int = 16, rounds: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (always null under this law)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "shard")
    text = whole_text(text_col)
    nodes = scratch.save(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("group"),
        ),
        "nodes",
    )
    groups = nodes.groupBy("group").agg(F.count("*").alias("members")).filter("members > 1")
    rows = nodes.count()
    hot = scratch.save(groups.filter(F.col("members") * HOT > rows).select("group"), "hot")  # fewer than HOT rows
    groups = groups.filter(F.col("members") * HOT <= rows)
    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    common = nodes.join(F.broadcast(hot), "group", "left_semi").withColumn("hot", F.lit(True))
    others = nodes.join(F.broadcast(hot), "group", "left_anti")
    some = others.join(groups, "group", "left_semi").withColumn("hot", F.lit(False))
    linked = scratch.save(common.unionByName(some).withColumn("shard", start), "linked-0")
    quota = [rows // shards + (i < rows % shards) for i in range(shards)]
    quotas = F.array(*[F.lit(q).cast("long") for q in quota])
    for k in range(rounds):
        room = [q - n for q, n in zip(quota, _loads(linked, shards), strict=True)]
        asking = scratch.save(_asking(linked, room), f"asking-{k}")
        flow = [[0] * shards for _ in range(shards)]
        for r in asking.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect():
            flow[r["shard"]][r["to"]] = r["n"]
        flow = balanced(flow, room)
        if not any(map(any, flow)):
            break
        linked = scratch.save(_moved(linked, hot, asking, flow, k), f"linked-{k + 1}")
        scratch.drop(f"linked-{k}", f"asking-{k}")
    buckets = max(4, rows // (shards * 100_000))
    load = _loads(linked, shards)
    placed = running(linked, ["shard"], _order(), _order(), "slot", buckets=buckets)
    if all(n <= q for n, q in zip(load, quota, strict=True)):
        kept, spilled = placed, None
    else:
        placed = scratch.save(placed, "placed")
        fits = F.col("slot") < F.element_at(quotas, F.col("shard") + 1)
        kept, spilled = placed.filter(fits), placed.filter(~fits)
        load = [min(n, q) for n, q in zip(load, quota, strict=True)]
    single = others.join(groups, "group", "left_anti")
    columns = ["doc_id", "size", "text_crc32"]
    loose = single.select(*columns)
    if spilled is not None:
        loose = loose.unionByName(spilled.select(*columns))
    filled = _fill(loose, [q - n for q, n in zip(quota, load, strict=True)], load, buckets * shards)
    out = kept.select(*columns, "shard", "slot").unionByName(filled)
    return out.select(
        *columns,
        F.lit("rows").alias("law"),
        F.col("shard").cast("int"),
        F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def _loads(linked: DataFrame, shards: int) -> list[int]:
    """Linked rows of each shard: as many numbers as there are shards."""
    found = {r["shard"]: r["count"] for r in linked.groupBy("shard").count().collect()}
    return [found.get(i, 0) for i in range(shards)]


def balanced(asked: list[list[int]], room: list[int]) -> list[list[int]]:
    """How many may go from shard to shard, of those that ask: none gets more than its room and what leaves it.

    First what goes round in circles, which needs no room; the requests left
    have no circle, and room is handed up along them.
    """
    shards = range(len(room))
    left = [list(row) for row in asked]
    flow = [[0] * len(room) for _ in shards]
    slack = list(room)

    def go(i: int, j: int, n: int) -> None:
        left[i][j] -= n
        flow[i][j] += n
        slack[i] += n
        slack[j] -= n

    for i in shards:
        for j in shards:
            if i != j and (n := min(left[i][j], left[j][i])) > 0:
                go(i, j, n)
                go(j, i, n)
    while circle := _circle(left):
        n = min(left[i][j] for i, j in circle)
        for i, j in circle:
            go(i, j, n)
    moved = True
    while moved:
        moved = False
        for j in shards:
            for i in sorted(shards, key=lambda i: -left[i][j]):
                if (n := min(left[i][j], slack[j])) > 0:
                    go(i, j, n)
                    moved = True
    return flow


def _circle(left: list[list[int]]) -> list[tuple[int, int]]:
    """The steps of some circle of requests; none if there is none."""
    done: set[int] = set()
    for start in range(len(left)):
        path, tries = [start], [iter(range(len(left)))]
        while path and path[0] not in done:
            i = path[-1]
            for j in tries[-1]:
                if left[i][j] > 0 and j in path:
                    ring = [*path[path.index(j) :], j]
                    return list(zip(ring, ring[1:], strict=False))
                if left[i][j] > 0 and j not in done:
                    path.append(j)
                    tries.append(iter(range(len(left))))
                    break
            else:
                done.add(i)
                path.pop()
                tries.pop()
    return []


def _asking(linked: DataFrame, room: list[int]) -> DataFrame:
    """(group, shard, to, n, gain): fragments that would move, and to where."""
    fragments = linked.groupBy("group", "shard").agg(F.count("*").alias("n"))
    free = F.element_at(F.array(*[F.lit(n > 0) for n in room]), F.col("shard") + 1)
    rank = F.struct(free.alias("free"), F.col("n"), F.xxhash64("group", "shard").alias("tie"), F.col("shard").alias("to"))
    best = fragments.groupBy("group").agg(F.max(rank).alias("best"))
    asking = fragments.join(best.select("group", F.col("best.to").alias("to"), F.col("best.n").alias("there")), "group")
    asking = asking.withColumn("gain", F.col("there") - F.col("n"))
    return asking.filter((F.col("shard") != F.col("to")) & (F.col("gain") >= 0)).select("group", "shard", "to", "n", "gain")


def _moved(linked: DataFrame, hot: DataFrame, asking: DataFrame, flow: list[list[int]], turn: int) -> DataFrame:
    """The rows after what may go has gone."""
    shards = len(flow)
    flows = F.array(*[F.lit(n).cast("long") for row in flow for n in row])
    queued = running(asking, ["shard", "to"], [F.col("gain").desc(), F.col("group")], [F.col("group")], "ahead", F.col("n"), buckets=64)
    may = F.element_at(flows, F.col("shard") * shards + F.col("to") + 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (may - F.col("ahead")) / F.col("n")))
    granted = queued.select("group", "shard", "to", share.alias("share")).filter("share > 0")
    # the rows of a fragment are alike, so those whose hash of this round lies under the share go
    goes = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(1_000_000)) < F.col("share") * 1_000_000
    # of a hot group there is a fragment per shard at most
    few = granted.join(F.broadcast(hot), "group", "left_semi")
    moved = linked.filter("hot").join(F.broadcast(few), ["group", "shard"], "left")
    moved = moved.unionByName(linked.filter("not hot").join(granted, ["group", "shard"], "left"))
    return moved.select("doc_id", "size", "text_crc32", "group", "hot", F.when(goes, F.col("to")).otherwise(F.col("shard")).alias("shard"))


def _fill(loose: DataFrame, free: list[int], load: list[int], buckets: int) -> DataFrame:
    """Deal rows without a place into the free slots, shard after shard."""
    ends, total = [], 0
    for n in free:
        total += n
        ends.append(total)
    numbered = running(loose.withColumn("all", F.lit(0)), ["all"], _order(), _order(), "nth", buckets=buckets)
    to, slot = F.lit(len(free) - 1), F.col("nth") - (ends[-1] - free[-1]) + load[-1]
    for i in range(len(free) - 2, -1, -1):
        inside = F.col("nth") < ends[i]
        to = F.when(inside, F.lit(i)).otherwise(to)
        slot = F.when(inside, F.col("nth") - (ends[i] - free[i]) + load[i]).otherwise(slot)
    return numbered.select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.alias("slot"))


def cut_links(sharded: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between equal texts that a sharding cuts: pairs of a group less pairs of its fragments."""
    by = sharded.join(groups, "doc_id").groupBy("group", "shard").agg(F.count("*").alias("n"))
    per = by.groupBy("group").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inside"))
    return per.agg(F.sum(F.col("all") * (F.col("all") - 1) / 2 - F.col("inside")).alias("cut"), F.sum("inside").alias("kept"))
