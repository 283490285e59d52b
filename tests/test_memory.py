"""The facade and the streams."""

import datetime as dt

from pyspark.sql import functions as F

from tempograph.api import Memory
from tempograph.functions import udf
from tempograph.streaming import ingest


def test_remember_recall_forget(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "memory"))
    day = dt.datetime(2024, 1, 1)
    episodes = spark.createDataFrame([(1, "Ada wrote the first program", day, "g", "s1"), (2, "Grace found the bug", day, "g", "s2")], "id long, content string, timestamp timestamp_ntz, group_id string, source_id string")
    facts = spark.createDataFrame(
        [(1, "ada", "wrote", "program", day, None, 1), (2, "ada", "wrote", "program", day, None, 1), (3, "grace", "found", "bug", day, dt.datetime(2024, 2, 1), 2)],
        "id long, subject_id string, predicate string, object_value string, valid_from timestamp_ntz, valid_to timestamp_ntz, source_episode_id long",
    )
    assert m.remember(episodes, facts)["duplicate"] == 1
    assert [r.id for r in m.content("the bug").collect()] == [2]
    assert {r.id for r in m.content("program nosuchword").collect()} == {1}
    assert {r.id for r in m.facts_at("2024-03-01 00:00:00").collect()} == {1}
    assert m.dream("2024-03-01 00:00:00")["candidates"] == 1
    assert m.facts_at("2024-01-15 00:00:00").count() == 1
    assert not m.supersede(1, "2023-01-01 00:00:00") and m.supersede(1, "2024-06-01 00:00:00")
    assert m.forget("s1") == 1
    assert m.table("episodes").count() == 1 and m.sql("select count(*) from facts").first()[0] == 1


FACT = "id long, subject_id string, predicate string, object_id string, valid_from timestamp_ntz, source_episode_id long"


def test_forget_takes_what_only_the_source_mentions(spark, tmp_path):
    m = Memory(spark, str(tmp_path / "memory"))
    day = dt.datetime(2024, 1, 1)
    episodes = spark.createDataFrame([(1, "a", day, "g", "s1"), (2, "b", day, "g", "s2")], "id long, content string, timestamp timestamp_ntz, group_id string, source_id string")
    entities = spark.createDataFrame([("ada", "g"), ("grace", "g"), ("both", "g")], "id string, group_id string")
    mentions = spark.createDataFrame([(1, "ada"), (1, "both"), (2, "both"), (2, "grace")], "episode_id long, entity_id string")
    facts = spark.createDataFrame([(1, "ada", "knows", "both", day, 1), (2, "grace", "knows", "both", day, 2), (3, "grace", "knows", "ada", day, 2)], FACT)
    assert m.remember(episodes, facts, entities, mentions)["inserted"] == 3
    assert m.forget("s1") == 1
    assert {r.id for r in m.table("entities").collect()} == {"grace", "both"}
    assert {(r.episode_id, r.entity_id) for r in m.table("episodic_edges").collect()} == {(2, "both"), (2, "grace")}
    assert {r.id for r in m.table("facts").collect()} == {2}  # the third is about one that went
    assert {r.id for r in m.table("episodes").collect()} == {2}
    for name in m.KEYS:
        m.compact(name)
    assert {r.id for r in m.table("facts").collect()} == {2} and m.table("entities").count() == 2


def test_concurrent_writers_insert_a_fact_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    m = Memory(spark, str(tmp_path / "memory"))
    day = dt.datetime(2024, 1, 1)

    def write(i):
        episodes = spark.createDataFrame([(i, f"text {i}", day, "g", f"s{i}")], "id long, content string, timestamp timestamp_ntz, group_id string, source_id string")
        facts = spark.createDataFrame([(10 * i, "ada", "knows", "grace", day, i), (10 * i + 1, "ada", "knows", f"e{i}", day, i)], FACT)
        return Memory(spark, m.root).remember(episodes, facts)

    with ThreadPoolExecutor(3) as pool:
        counts = list(pool.map(write, range(3)))
    assert sum(c["inserted"] for c in counts) == 4 and sum(c["duplicate"] for c in counts) == 2
    assert m.head() == 3 and m.table("episodes").count() == 3
    triples = [(r.subject_id, r.object_id) for r in m.table("facts").collect()]
    assert sorted(triples) == [("ada", "e0"), ("ada", "e1"), ("ada", "e2"), ("ada", "grace")]


def test_stream_keeps_facts_between_entities(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, "a", "knows", f"e{i % 10}", None) for i in range(20)] + [(20, "a", "knows", None, "e1"), (21, None, "knows", None, None)]
    facts = spark.createDataFrame(rows, "id long, subject_id string, predicate string, object_id string, object_value string")
    facts.write.parquet(source)
    stream = ingest.deduplicated(ingest.read_events(spark, source, facts.schema))
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 11 and got.filter("content_hash is null").count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, f"s{i % 3}", "p", str(i % 4)) for i in range(40)]
    facts = spark.createDataFrame(rows, "id long, subject_id string, predicate string, object_value string")
    facts.repartition(4).write.parquet(source)
    stream = ingest.deduplicated(ingest.read_events(spark, source, facts.schema, per_trigger=1))
    ingest.write(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("subject_id", "object_value").distinct().count() == got.count() == 12


def test_stateful_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    outcomes = spark.createDataFrame([("a", "done", 2), ("a", "done", 2), ("b", "done", 2), ("c", "failed", 1)], "batch_id string, outcome string, total long")
    outcomes.write.parquet(source)
    states = ingest.batch_states(ingest.read_events(spark, source, outcomes.schema))
    query = states.writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.batch_id: r.status for r in spark.table("states").collect()} == {"a": "complete", "b": "pending", "c": "failed"}


def test_chunks_and_vectors(spark):
    text = "One sentence here. Another one follows it.\n\nA new paragraph of some length. " * 5
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, content string")
    parts = udf.chunked(frame, 60).filter("id = 1").orderBy("chunk").collect()
    assert "".join(p.body for p in parts) == text and all(len(p.body) <= 60 for p in parts)
    vectors = udf.backfill(frame.withColumn("embedding", F.lit(None).cast("array<float>")), udf.hash_embedder(8))
    assert all(len(r.embedding) == 8 for r in vectors.collect())
    assert spark.range(1).select(udf.stemmed_tokens(F.lit("Running horses über"))).first()[0] == ["runn", "horse", "uber"]
