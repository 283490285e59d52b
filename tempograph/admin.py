"""Maintenance of a memory's folder: ``python -m tempograph.admin verify|compact|migrate|backup|policy ROOT ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tempograph import schema
from tempograph.api import Memory


def verify(memory: Memory) -> dict[str, int | bool]:
    """Rows per table, tables of the schema that are missing, and facts whose episode is gone."""
    report: dict[str, int | bool] = {name: memory.table(name).count() for name in memory.KEYS}
    report["missing_tables"] = len(set(schema.CRITICAL) - set(schema.TABLES))
    facts, episodes = memory.table("facts"), memory.table("episodes").select(F.col("id").alias("source_episode_id"))
    report["facts_without_episode"] = facts.filter("source_episode_id is not null").join(episodes, "source_episode_id", "left_anti").count()
    return report


def migrate(memory: Memory) -> int:
    """Bring every table to the schema of this version: new columns are null, columns no longer known go; one commit."""
    names = tuple(memory.KEYS)
    return memory.commit(lambda: ({n: [(memory.table(n), False)] for n in names}, memory.head() + 1), base=names)


def backup(memory: Memory, target: str) -> str:
    """A copy of the folder as of the newest commit."""
    jvm, conf = memory.spark._jvm, memory.spark._jsc.hadoopConfiguration()
    source, fs = memory._hadoop(memory.root)
    to, other = memory._hadoop(f"{target.rstrip('/')}/{memory.head():020d}")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, other, to, False, conf)
    return to.toString()


def upgrade(memory: Memory, namespace: str) -> bool:
    """A namespace that may change becomes one that only appends; there is no way back."""
    own = memory.table("namespaces").filter(F.col("group_id") == namespace)
    if own.filter(F.get_json_object("policy_json", "$.policy") == "AppendOnly").count():
        return False
    row = memory.spark.createDataFrame([(namespace, json.dumps({"policy": "AppendOnly"}))], "group_id string, policy_json string")
    memory.append("namespaces", row)
    return True


def main(arguments: list[str]) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("command", choices=("verify", "compact", "migrate", "backup", "policy"))
    parser.add_argument("root")
    parser.add_argument("rest", nargs="*")
    given = parser.parse_args(arguments)
    memory = Memory(SparkSession.builder.getOrCreate(), given.root)
    if given.command == "compact":
        for name in given.rest or memory.KEYS:
            memory.compact(name)
        return
    act = {"verify": lambda: verify(memory), "migrate": lambda: migrate(memory), "backup": lambda: backup(memory, given.rest[0]), "policy": lambda: upgrade(memory, given.rest[0])}
    print(json.dumps(act[given.command]()))


if __name__ == "__main__":
    main(sys.argv[1:])
