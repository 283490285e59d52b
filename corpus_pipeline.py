"""A cleaning pipeline over ``documents`` in five stages, each on what the one before kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  All but the last keep the columns of ``documents``.
A stage writes what it must hold to ``spark.checkpoint.dir``; its result is
written as Parquet and read again for the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm.common import Scratch
from tempograph.llm.decontamination import decontaminated
from tempograph.llm.queries import PIECES, table, tokenizer_path
from tempograph.llm.segmentation import sample_segmentations
from tempograph.llm.simhash import similar_groups
from tempograph.llm.suffix_dedup import remove_repeats
from tempograph.llm.toxicity import clean, learn

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is one half or more go; the lexicon is learned from the labelled ones left."""
    return clean(docs, learn(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles alike to 0.8 or more) the one of least id stays, of equal rows the first."""
    return similar_groups(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes or more that also start earlier go from the texts; documents of which nothing is left go."""
    kept = remove_repeats(docs, carried=("lang", "source"), as_text=True)
    left = kept.filter((F.col("n_removed") < F.col("n_bytes")) | (F.col("n_bytes") == 0))
    return left.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every text."""
    return sample_segmentations(docs, tokenizer_path(PIECES))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", pieces),
]

#: Learned lexicons, code words and sampling are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    opened = len(Scratch.held)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            Scratch.sweep(opened)  # what the stage held
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
