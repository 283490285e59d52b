"""Bottom-k sketches of shingle hashes, in DataFrame functions alone.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a
text's word shingles.  Sketches of parts merge into the sketch of the whole
(``merged``), and two of them estimate resemblance, containment and the number
of distinct shingles.

A null text counts as empty; a text without words has the empty sketch, two
empty sketches resemble each other fully and an empty one resembles no other.
Texts with fewer words than a shingle are one shingle.  Equal texts have equal
sketches, repeated rows each get theirs, extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, parallelism, save_bucketed, whole_text, words_of

LOWEST, SPAN = -(2.0**63), 2.0**64


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """One hash per shingle: the hash of the hashes of its words."""
    hashed = F.transform(words_of(ascii_lower(text)), lambda w: F.xxhash64(w))

    def rolled(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
        return F.when(
            F.size(words) >= size,
            F.transform(starts, lambda i: F.xxhash64(*[F.element_at(words, i + j) for j in range(size)])),
        ).when(F.size(words) > 0, F.array(F.xxhash64(words)))

    # a one-element array lets the lambda hold the word hashes, so that they are made once
    return F.coalesce(F.transform(F.array(hashed), rolled)[0], F.array().cast("array<bigint>"))


def sketch(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merged(a: Column, b: Column, k: int) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold."""
    whole = F.size(merged(a, b, k))
    both = F.size(F.array_intersect(merged(a, b, k), F.array_intersect(a, b)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / whole)


def distinct_shingles(a: Column, k: int) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's share of the range."""
    share = (F.element_at(a, -1).cast("double") - F.lit(LOWEST)) / F.lit(SPAN)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int) -> Column:
    """Estimated share of a's shingles that b holds too (0 for an empty a)."""
    union = distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(df: DataFrame, k: int = 128, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, sketch and estimated number of distinct shingles of each row."""
    made = df.select(F.col(id_col), sketch(shingle_hashes(whole_text(text_col), size), k).alias("sketch"))
    return made.withColumn("distinct_shingles", distinct_shingles(F.col("sketch"), k))


def beside_next(df: DataFrame, k: int = 128, size: int = 5, range_bytes: int = 32_000_000) -> DataFrame:
    """Fingerprints of each text and of its mixture with the next document.

    "Next" is by descending (doc_id, hash of the text, text); null ids come
    last, after the last row comes the first.  Rows are sorted into ranges of
    about ``range_bytes`` by id, hash and place in the input, so neither sparse
    ids nor an id (or none) that many rows have makes a range larger.  The
    ranges are written bucketed by their number, so the texts are shuffled
    once; the head of each range (one row of many) reaches the tail of the one
    before it through a small join, and one task orders the numbers of the
    ranges, no rows.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "sketches")
    docs = df.select(F.col("doc_id").cast("long"), whole_text("text").alias("text")).withColumn("tie", F.xxhash64("text"))
    amount = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(parallelism(spark), -(-amount // range_bytes))
    along = docs.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(ranges, F.col("doc_id").desc_nulls_last(), "tie", "row")
    dealt = save_bucketed(scratch, along.drop("row").withColumn("bucket", F.spark_partition_id()), "ranges", "bucket")
    down = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie", "text")
    dealt = dealt.withColumn("place", F.row_number().over(down)).withColumn("below", F.lead("text").over(down))
    heads = dealt.filter("place = 1").select(F.col("bucket").alias("head_bucket"), F.col("text").alias("head_text"))
    tails = _followed(dealt.select("bucket").distinct())
    heads = tails.join(heads, tails.next_bucket == heads.head_bucket).select("bucket", "head_text")
    heads = heads.withColumn("head_sketch", sketch(shingle_hashes(F.col("head_text"), size), k))
    half = F.floor(F.length("text") / 2).cast("int")
    full = (
        dealt.join(heads, "bucket", "left")
        .withColumn("next_text", F.coalesce("below", "head_text"))
        .withColumn("is_tail", F.col("below").isNull())
        .select(
            "doc_id", "bucket", "text", "is_tail", "place", "head_sketch",
            F.length("text").cast("long").alias("n_chars"),
            F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)).alias("edited"),
        )
        .select(
            "doc_id", "bucket", "n_chars", "is_tail", "place", "head_sketch",
            F.sha2("edited", 256).alias("edited_sha256"),
            sketch(shingle_hashes(F.col("text"), size), k).alias("own"),
            sketch(shingle_hashes(F.col("edited"), size), k).alias("changed"),
        )
    )
    onward = Window.partitionBy("bucket").orderBy("place")
    full = full.withColumn("after", F.lead("own").over(onward))
    full = full.withColumn("after", F.when(F.col("is_tail"), F.col("head_sketch")).otherwise(F.col("after")))
    return full.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("own")).alias("fingerprint"),
        printed(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed"), k).alias("near_edited"),
        resemblance(F.col("own"), F.col("after"), k).alias("near_next"),
        distinct_shingles(F.col("own"), k).alias("distinct_shingles"),
        containment(F.col("own"), F.col("changed"), k).alias("contained_in_edited"),
    )


def _followed(buckets: DataFrame) -> DataFrame:
    """The number of each range with that of the next one that has rows, the last with the first."""
    order = Window.orderBy("bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return buckets.select("bucket", F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole)).alias("next_bucket"))
