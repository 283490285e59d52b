"""The memory as one object: tables are Parquet versions, reads are DataFrames."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Any, ClassVar

from py4j.protocol import Py4JJavaError

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph import schema
from tempograph.config import DEFAULT, Config
from tempograph.functions import temporal, text
from tempograph.functions.scoring import decide_bulk
from tempograph.operators import mutate, search
from tempograph.operators.graph import kept

#: Renames on a local file system look before they leap; writers of one process take turns.
_claims = threading.Lock()


class Conflict(Exception):
    """Another writer's commit came first."""


class Memory:
    """Append-only commits under one folder; the latest row of a key counts.

    A write puts its rows, of all tables, into folders of its own and then
    creates one manifest, ``_commits/<version>.json``, that names them.  Readers
    see manifests only, so they see a write whole or not at all; a writer whose
    version is taken already judges its rows anew and tries the next one, so
    two writers never insert the same fact.  The manifest is put in place by
    the file system's rename that does not overwrite.  Undoing is one more
    commit; ``compact`` writes a table's latest rows as the base of later reads.
    """

    KEYS: ClassVar[dict[str, list[str]]] = {"episodes": ["id"], "facts": ["id"], "entities": ["id", "group_id"], "episodic_edges": ["episode_id", "entity_id"], "graph_mutation_log": ["id"], "entity_types": ["group_id", "id"], "namespaces": ["group_id"]}

    def __init__(self, spark: SparkSession, root: str, config: Config = DEFAULT):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config

    # commits

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[dict]:
        """What each commit wrote, in order: as many small files as there are commits since the last compaction of all tables."""
        path, fs = self._hadoop(f"{self.root}/_commits")
        if not fs.exists(path):
            return []
        names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getPath().getName().endswith(".json"))
        if not names:
            return []
        texts = self.spark.sparkContext.wholeTextFiles(f"{self.root}/_commits/*.json").collect()
        return [json.loads(t) for _, t in sorted(texts)]

    def head(self) -> int:
        found = self._manifests()
        return found[-1]["version"] if found else 0

    def _claim(self, version: int, manifest: dict) -> None:
        """Put the manifest of a version in place, or raise ``Conflict``."""
        jvm = self.spark._jvm
        target, fs = self._hadoop(f"{self.root}/_commits/{version:020d}.json")
        draft, _ = self._hadoop(f"{self.root}/_drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest | {"version": version}).encode()))
        out.close()
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        with _claims:
            try:
                context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
            except Py4JJavaError as error:
                if "FileAlreadyExists" in str(error):
                    raise Conflict(str(version)) from None
                raise

    def commit(self, judge: Callable[[], tuple[dict[str, list[tuple[DataFrame, bool]]], Any]], base: tuple[str, ...] = (), tries: int = 20) -> Any:
        """Write what ``judge`` finds right for the newest commit; it gives rows (and whether they are dropped) by table, and a result."""
        for _ in range(tries):
            version = self.head() + 1
            writes, result = judge()
            if not writes:
                return result
            folders = {}
            for name, parts in writes.items():
                for rows, dropped in parts:
                    folder = f"{name}/{uuid.uuid4().hex}"
                    self._full(name, rows, version, dropped).write.parquet(f"{self.root}/{folder}")
                    folders.setdefault(name, []).append(folder)
            try:
                self._claim(version, {"folders": folders, "base": list(base)})
            except Conflict:
                for f in (f for own in folders.values() for f in own):
                    path, fs = self._hadoop(f"{self.root}/{f}")
                    fs.delete(path, True)
                continue
            return result
        raise Conflict(f"{tries} commits of others came first")

    def _full(self, name: str, rows: DataFrame, version: int, dropped: bool) -> DataFrame:
        have = set(rows.columns)
        fields = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.TABLES[name]]
        return rows.select(*fields, F.lit(version).cast("long").alias("version"), F.lit(dropped).alias("dropped"))

    def compact(self, name: str) -> None:
        """The latest rows of a table as one folder, from which later reads begin; older folders stay for readers that hold them."""
        self.commit(lambda: ({name: [(self.table(name), False)]}, None), base=(name,))

    # tables

    def versions(self, name: str) -> DataFrame:
        fields = T.StructType([*schema.TABLES[name], T.StructField("version", T.LongType()), T.StructField("dropped", T.BooleanType())])
        folders: list[str] = []
        for m in self._manifests():
            folders = ([] if name in m["base"] else folders) + [f"{self.root}/{f}" for f in m["folders"].get(name, [])]
        return self.spark.read.schema(fields).parquet(*folders) if folders else self.spark.createDataFrame([], fields)

    def table(self, name: str) -> DataFrame:
        newest = Window.partitionBy(*self.KEYS[name]).orderBy(F.col("version").desc(), F.col("dropped"))
        rows = self.versions(name).withColumn("_k", F.row_number().over(newest))
        return rows.filter("_k = 1 and not dropped").drop("_k", "version", "dropped")

    def append(self, name: str, rows: DataFrame, dropped: bool = False) -> None:
        self.commit(lambda: ({name: [(rows, dropped)]}, None))

    # writes

    def remember(self, episodes: DataFrame, facts: DataFrame | None = None, entities: DataFrame | None = None, mentions: DataFrame | None = None) -> dict[str, int]:
        """Episodes (id, content, timestamp, group_id, ...) with the facts, entities and mentions that the caller found in them, as one commit."""

        def judge() -> tuple[dict, dict[str, int]]:
            writes = {"episodes": [(episodes.withColumn("content_hash", F.sha2("content", 256)), False)]}
            counts = {"inserted": 0, "duplicate": 0, "self-loop": 0}
            if entities is not None:
                writes["entities"] = [(entities, False)]
            if mentions is not None:
                writes["episodic_edges"] = [(mentions.dropDuplicates(["episode_id", "entity_id"]), False)]
            if facts is not None:
                full = facts
                for name in ("object_id", "object_value", "expired_at"):
                    if name not in full.columns:
                        full = full.withColumn(name, F.lit(None).cast(schema.FACTS[name].dataType))
                hashed = full.withColumn("content_hash", text.fact_hash(F.col("subject_id"), F.col("predicate"), F.coalesce("object_id", "object_value")))
                judged = kept(mutate.insert_outcome(self.table("facts"), hashed, ["content_hash"]))
                writes["facts"] = [(judged.filter("outcome = 'inserted'").drop("outcome"), False)]
                counts |= {r["outcome"]: r["count"] for r in judged.groupBy("outcome").count().collect()}
            return writes, counts

        return self.commit(judge)

    def supersede(self, fact_id: int, end: str) -> bool:
        """Bound a fact's world time; refused before its start."""

        def judge() -> tuple[dict, bool]:
            bounded = mutate.bound(self.table("facts").filter(F.col("id") == fact_id), F.lit(True), temporal.instant(end))
            rows = kept(bounded.filter("not rejected").drop("rejected"))
            return ({}, False) if rows.isEmpty() else ({"facts": [(rows, False)]}, True)

        return self.commit(judge)

    def forget(self, source: str) -> int:
        """Episodes of a source go, with their facts and mentions, the entities that only they mention, and the facts about those."""

        def judge() -> tuple[dict, int]:
            episodes, mentions, facts, entities = (self.table(n) for n in ("episodes", "episodic_edges", "facts", "entities"))
            own = kept(episodes.filter(F.col("source_id") == source).select("id"))
            mine = own.select(F.col("id").alias("episode_id"))
            gone = kept(mentions.join(mine, "episode_id", "left_semi").select("entity_id").distinct().join(mentions.join(mine, "episode_id", "left_anti").select("entity_id"), "entity_id", "left_anti"))
            by_episode = facts.join(own.withColumnRenamed("id", "source_episode_id"), "source_episode_id", "left_semi")
            about = [facts.join(gone.withColumnRenamed("entity_id", end), end, "left_semi").select(*facts.columns) for end in ("subject_id", "object_id")]
            lost = by_episode.select(*facts.columns).union(about[0]).union(about[1]).dropDuplicates(["id"])
            return {
                "facts": [(lost, True)],
                "episodic_edges": [(mentions.join(mine, "episode_id", "left_semi"), True)],
                "entities": [(entities.join(gone.withColumnRenamed("entity_id", "id"), "id", "left_semi"), True)],
                "episodes": [(episodes.join(own, "id", "left_semi"), True)],
            }, own.count()

        return self.commit(judge)

    def dream(self, now: str) -> dict[str, str | int]:
        """Close out passed windows, unless that would expire too large a share at once."""
        t = temporal.instant(now)

        def judge() -> tuple[dict, dict[str, str | int]]:
            facts = self.table("facts")
            due = F.col("expired_at").isNull() & (F.col("valid_to") < t)
            one = facts.agg(F.coalesce(F.sum(due.cast("long")), F.lit(0)).alias("c"), F.coalesce(F.sum(F.col("expired_at").isNull().cast("long")), F.lit(0)).alias("live"))
            row = one.select("c", "live", decide_bulk(F.col("c"), F.col("live"), self.config.bulk_minimum, self.config.bulk_share).alias("decision")).first()
            report = {"candidates": row["c"], "live": row["live"], "decision": row["decision"]}
            if row["decision"] != "Allowed" or not row["c"]:
                return {}, report
            return {"facts": [(temporal.close_out(facts.filter(due), t), False)]}, report

        return self.commit(judge)

    # reads

    def facts_at(self, t: str) -> DataFrame:
        return temporal.facts_at(self.table("facts"), temporal.instant(t))

    def history(self, entity: str) -> DataFrame:
        return temporal.history(self.table("facts").filter(F.col("subject_id") == entity))

    def content(self, query: str, k: int | None = None, namespaces: list[str] | None = None, as_of: str | None = None) -> DataFrame:
        """Episodes by BM25, all words first, any word if none holds all."""
        docs = self.table("episodes").filter(text.in_namespaces(namespaces or []))
        if as_of:
            docs = docs.filter(F.col("timestamp") <= temporal.instant(as_of))
        words = self.spark.range(1).select(text.tokens(F.lit(query)).alias("w")).first()["w"]
        return search.head(search.ladder(docs, list(words)), k or self.config.top_k)

    def sql(self, statement: str) -> DataFrame:
        for name in self.KEYS:
            self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(statement)
