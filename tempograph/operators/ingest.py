"""What ingestion makes of extracted rows before they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempograph.functions import text


def resolved(extracted: DataFrame, existing: DataFrame) -> DataFrame:
    """Extracted names (name, ...) with ``decision`` and the entity meant: reuse of one known, a potential alias of one, or insert.

    A name is reused if it is known as it is when normalised; it may be an alias
    of the first entity that has the same words in another order or number.
    """
    key = lambda c: F.array_join(F.array_sort(F.array_distinct(text.tokens(c))), " ")
    known = existing.select("id", text.normalize_name(F.col("name")).alias("_norm"), key(F.col("name")).alias("_words"))
    same = known.groupBy("_norm").agg(F.min("id").alias("_same"))
    like = known.groupBy("_words").agg(F.min("id").alias("_like"))
    own = extracted.withColumn("_norm", text.normalize_name(F.col("name"))).withColumn("_words", key(F.col("name")))
    both = own.join(same, "_norm", "left").join(like, "_words", "left")
    decision = F.when(F.col("_same").isNotNull(), "reuse").when(F.col("_like").isNotNull(), "alias").otherwise("insert")
    return both.withColumn("decision", decision).withColumn("entity", F.coalesce("_same", "_like")).drop("_same", "_like", "_norm", "_words")


def stubs(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(id): ends of pinned facts that no entity has yet, once each."""
    ends = facts.select(F.explode(F.array("subject_id", "object_id")).alias("id")).filter("id is not null").distinct()
    return ends.join(entities.select("id"), "id", "left_anti")


def alias_facts(pairs: DataFrame, low: float, high: float) -> DataFrame:
    """A ``potential_alias`` fact, with the likeness as its confidence, for each pair between two bounds."""
    near = pairs.filter((F.col("score") >= low) & (F.col("score") < high))
    return near.select(F.col("a").alias("subject_id"), F.lit("potential_alias").alias("predicate"), F.col("b").alias("object_id"), F.col("score").alias("confidence"))


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the columns of those that a change names; a null change leaves the value."""
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


def sagas(episodes: DataFrame) -> DataFrame:
    """Episodes with the hash of their text, their saga (the source), and their number in it."""
    order = Window.partitionBy("saga_id").orderBy("timestamp", "id")
    hashed = episodes.withColumn("saga_id", F.col("source_id")).withColumn("content_hash", F.sha2("content", 256))
    return hashed.withColumn("sequence_number", F.row_number().over(order).cast("long"))


def document_graph(documents: DataFrame, windows: Column) -> tuple[DataFrame, DataFrame]:
    """A document as an anchor entity with one entity per window of its text, and the edges between them."""
    anchor = F.concat(F.lit("doc:"), F.col("id").cast("string"))
    parts = documents.select(anchor.alias("anchor"), F.posexplode(windows).alias("k", "body"))
    parts = parts.withColumn("id", F.concat_ws("#", "anchor", F.col("k").cast("string")))
    entities = documents.select(anchor.alias("id"), F.lit("anchor").alias("kind")).union(parts.select("id", F.lit("part").alias("kind")))
    return entities, parts.select(F.col("anchor").alias("subject_id"), F.lit("contains").alias("predicate"), F.col("id").alias("object_id"))


def registered(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, type_id): each name's type, whatever its case; names not yet registered get the next numbers in their order."""
    wanted = names.select(F.lower(F.trim("name")).alias("key"), "name").groupBy("key").agg(F.min("name").alias("name"))
    known = registry.select(F.lower("name").alias("key"), F.col("id").alias("known"))
    top = registry.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    both = wanted.join(known, "key", "left")
    # new types are few (a registry names what a model can tell apart), so one task numbers them
    fresh = both.filter("known is null").withColumn("n", F.row_number().over(Window.orderBy("key")))
    fresh = fresh.crossJoin(F.broadcast(top)).select("name", (F.col("top") + F.col("n")).cast("long").alias("type_id"))
    return both.filter("known is not null").select("name", F.col("known").cast("long").alias("type_id")).unionByName(fresh)
