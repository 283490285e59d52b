"""Full-text, vector and fused retrieval over whole tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.config import DEFAULT, Config
from tempograph.functions import scoring, vector
from tempograph.functions.text import tokens
from tempograph.operators.graph import shared_folder

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _bucket(term: Column, buckets: int) -> Column:
    """Where a shuffle by term into so many partitions puts it."""
    return F.pmod(F.hash(term), F.lit(buckets))


class TextIndex:
    """Postings of a text column: one row per term and document, in a folder per bucket of terms, and one slim row per document.

    Both are Parquet in the shared folder.  A search reads its terms' folders
    alone and of those, as they are sorted by term, the row groups that their
    statistics leave; it never reads the texts.
    ``carried`` columns stand in both, for filters.
    """

    def __init__(self, postings: DataFrame, docs: DataFrame, buckets: int):
        self.postings, self.docs, self.buckets = postings, docs, buckets

    @classmethod
    def build(cls, docs: DataFrame, text: str = "content", carried: tuple[str, ...] = (), parts: int | None = None) -> TextIndex:
        spark = docs.sparkSession
        root = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        keys = ["id", *carried]
        # each text is cut into words once; a document's words are counted inside its row, as runs of its sorted words
        cut = docs.select(*keys, F.array_sort(tokens(F.col(text))).alias("_words"))
        cut.write.parquet(f"{root}/words")
        words = spark.read.schema(cut.schema).parquet(f"{root}/words").withColumn("length", F.size("_words"))
        at = lambda i: F.get("_words", i)
        starts = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: (i == 1) | (at(i - 1) != at(i - 2)))
        begun = words.filter("length > 0").withColumn("_starts", starts)
        ends = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.col("length") + 1))
        runs = F.zip_with("_starts", ends, lambda a, z: F.struct(at(a - 1).alias("term"), (z - a).cast("long").alias("tf")))
        counted = begun.select(*keys, "length", F.inline(runs))
        parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # a bucket is what the shuffle by term makes of it anyway: one task, one folder
        spread = counted.withColumn("bucket", _bucket(F.col("term"), parts)).repartition(parts, "term").sortWithinPartitions("bucket", "term")
        spread.write.partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(f"{root}/postings")
        words.select(*keys, "length").write.parquet(f"{root}/docs")
        postings = spark.read.schema(spread.schema).parquet(f"{root}/postings")
        return cls(postings, spark.read.schema(words.select(*keys, "length").schema).parquet(f"{root}/docs"), parts)

    def where(self, condition: Column) -> TextIndex:
        """The index of the documents that meet a condition on the carried columns."""
        return TextIndex(self.postings.filter(condition), self.docs.filter(condition), self.buckets)

    def search(self, terms: list[str], any_term: bool = False, digits: int = 6) -> DataFrame:
        """Documents that hold all terms (or any), with their BM25 score: id, the carried columns, score."""
        terms = list(dict.fromkeys(terms))
        keys = [c for c in self.docs.columns if c != "length"]
        if not terms:
            return self.docs.select(*keys, F.lit(0.0).alias("score")).limit(0)
        folders = [F.col("bucket") == _bucket(F.lit(t), self.buckets) for t in terms]
        held = self.postings.filter(reduce(Column.__or__, folders) & F.col("term").isin(*terms))
        counts = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"_tf{i}") for i, t in enumerate(terms)]
        found = held.groupBy(*keys, "length").agg(*counts)
        sizes = self.docs.agg(F.count("*").alias("_n"), F.avg("length").alias("_mean"))
        frequencies = held.agg(*[F.coalesce(F.sum((F.col("term") == t).cast("long")), F.lit(0)).alias(f"_df{i}") for i, t in enumerate(terms)])
        stats = sizes.crossJoin(frequencies)  # one row each
        score: Column = F.lit(0.0)
        for i in range(len(terms)):
            tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
            idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("_mean")))
        if not any_term:
            for i in range(len(terms)):
                found = found.filter(F.col(f"_tf{i}") > 0)
        return found.crossJoin(F.broadcast(stats)).select(*keys, F.round(score, digits).alias("score"))

    def ladder(self, terms: list[str]) -> DataFrame:
        """All terms first; any term only when no document holds all."""
        every, some = self.search(terms), self.search(terms, any_term=True)
        hits = every.limit(1).agg(F.count("*").alias("_hits"))
        return every.unionByName(some.crossJoin(F.broadcast(hits)).filter("_hits = 0").drop("_hits"))


def bm25(docs: DataFrame, terms: list[str], text: str = "content", any_term: bool = False, digits: int = 6) -> DataFrame:
    """The same without an index: documents with their BM25 score, by one pass over the texts.

    Only counts of the query's terms and the length leave a row.  Words stand
    between blanks of their own, so that counts are plain string operations.
    """
    terms = list(dict.fromkeys(terms))
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")), " ", "  "), F.lit(" "))

    def times(part: str) -> Column:
        return ((F.length("_spaced") - F.length(F.replace(F.col("_spaced"), F.lit(part), F.lit("")))) / len(part)).cast("long")

    words = docs.withColumn("_spaced", spaced)
    length = F.when(F.trim("_spaced") == "", 0).otherwise(times("  ") + 1)
    counted = words.select(*docs.columns, length.alias("_length"), *[times(f" {t} ").alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = counted.agg(
        F.count("*").alias("_n"), F.avg("_length").alias("_mean"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))]
    )
    score: Column = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.greatest(F.log((F.col("_n") - df + 0.5) / (df + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_mean")))
    held = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    match = held[0] if held else F.lit(False)
    for h in held[1:]:
        match = (match | h) if any_term else (match & h)
    return counted.crossJoin(F.broadcast(stats)).filter(match).select(*docs.columns, F.round(score, digits).alias("score"))


def ladder(docs: DataFrame, terms: list[str], text: str = "content") -> DataFrame:
    """All terms first; any term only when no document holds all."""
    every, some = bm25(docs, terms, text), bm25(docs, terms, text, any_term=True)
    hits = every.limit(1).agg(F.count("*").alias("_hits"))
    rest = some.crossJoin(F.broadcast(hits)).filter("_hits = 0").drop("_hits")
    return every.unionByName(rest)


def head(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    return hits.orderBy(F.col("score").desc(), *(ties or ("id",))).limit(k)


def hybrid(hits: DataFrame, vectors: DataFrame, query: DataFrame, k: int, config: Config = DEFAULT, weights: tuple[float, float] | None = None, rrf_k: float | None = None) -> DataFrame:
    """Three times k of the text hits and of the nearest vectors, fused by rank, the best k."""
    w = weights or (1.0, 1.0)
    best = [F.col("score").desc(), F.col("id")]
    words = scoring.ranked(head(hits, 3 * k).select("id", "score"), ["id"], best)
    near = scoring.ranked(vector.top_k(vectors, query, 3 * k).select("id", "score"), ["id"], best)
    return head(scoring.rrf([(words, w[0]), (near, w[1])], ["id"], rrf_k if rrf_k is not None else config.hybrid_rrf_k), k)


def per_namespace(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each namespace, then of all."""
    from tempograph.functions.temporal import latest

    return head(latest(hits, ["group_id"], [F.col("score").desc(), F.col("id")], k), k)


def rerank(hits: DataFrame, scorer: Column, k: int) -> DataFrame:
    """The first k get a model's score and order; the tail follows as it was."""
    from pyspark.sql import Window

    placed = hits.withColumn("_place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    again = placed.withColumn("_model", F.when(F.col("_place") <= k, scorer))
    order = Window.orderBy(F.col("_model").desc_nulls_last(), "_place")
    return again.withColumn("rank", F.row_number().over(order).cast("long")).drop("_place", "_model")


def containing(docs: DataFrame, text: str, passages: DataFrame, passage: str, run: int = 5) -> DataFrame:
    """Documents (with a column ``id``) joined with the passages that they hold as substrings.

    All but a passage's first and last word are whole words of a text that
    holds it.  A passage is keyed by the first ``run`` of those, or by the
    longest of fewer; documents meet it by that key and are compared then.
    Passages of two words or fewer, which have none, are compared with every
    document.  Words are what stands between blanks.
    """
    words = F.split(F.col(passage), " ")
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    keyed = passages.withColumn("_inner", inner)
    longest = F.reduce("_inner", F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    long_ = keyed.filter(F.size("_inner") >= run).withColumn("_key", F.xxhash64(F.array_join(F.slice("_inner", 1, run), " "))).drop("_inner")
    short = keyed.filter((F.size("_inner") > 0) & (F.size("_inner") < run)).withColumn("_key", F.xxhash64(longest)).drop("_inner")
    rest = keyed.filter(F.size("_inner") == 0).drop("_inner")
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - (run - 1)), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, run), " ")))
    having = docs.select("id", F.split(F.col(text), " ").alias("_w"))
    by_run = having.filter(F.size("_w") >= run).select("id", F.explode(F.array_distinct(runs)).alias("_key"))
    by_word = having.select("id", F.explode(F.array_distinct(F.transform("_w", lambda w: F.xxhash64(w)))).alias("_key"))
    # only ids and keys are shuffled; texts join the few pairs that met
    met = by_run.join(long_, "_key").unionByName(by_word.join(short, "_key")).drop("_key")
    holds = F.contains(F.col(text), F.col(passage))
    return docs.join(met, "id").filter(holds).unionByName(docs.join(rest, holds))
