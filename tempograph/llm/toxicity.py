"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, drops zero-width characters, maps look-alike letters of
other scripts and digits that stand for letters, and turns everything between
words into one blank.  A lexicon term is a word or a word's beginning; its
weight is the smoothed log odds of the label among training documents that
hold it.  A term inside an exception phrase does not count, a word counts once
with its heaviest term, and the sum is normalised by the text's length before
a logistic curve makes it a score.

The lexicon and the curve are learned from labelled rows in the training fold,
at most ``sample`` of them, those of least hash of the id.  Nothing but the
text goes into a score.

Null texts count as empty; empty texts score too.  Rows without an id are
scored in the fold of remainder 0.  Repeated labels of a document each count;
null labels and labels without a document are ignored; with no label left the
seed terms and a fixed curve are used.  A seed term that ``support`` training
documents hold has the weight that their labels give it, or none.  Repeated rows each get a score, extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, crc_of_id

# Letters of other scripts by the Latin letter that they look like.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "ЬВβ", "c": "сϲ", "d": "ԁ", "e": "еεҽ", "g": "ɡ", "h": "һН", "i": "іιı", "j": "ј", "k": "кκ",
    "l": "ӏ", "m": "мМ", "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ν",
    "w": "ѡω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
UNSEEN = "​‌‍⁠﻿­"
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "circus clown", "pond scum", "sore loser")

_FOLD = str.maketrans(
    {c: latin for latin, others in LOOK_ALIKES.items() for c in others + others.lower()} | {c: None for c in UNSEEN}
)
_MIXED = re.compile(r"[\w@$]*[\d@$][\w@$]*")
_LETTERS = str.maketrans(DIGITS)
_HAS_DIGIT = re.compile("[" + re.escape("".join(DIGITS)) + "]")
_BETWEEN = re.compile(r"[\W_]+")


def _spelled(match: re.Match) -> str:
    """A token with at least two letters, its digits taken as the letters they stand for."""
    token = match[0].strip("@$")
    return token.translate(_LETTERS) if sum(map(str.isalpha, token)) > 1 else token


def fold(text: str) -> str:
    """The folded words of a text, a blank before and after each; l folds to i, as 1 stands for both."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    if _HAS_DIGIT.search(text):
        text = _MIXED.sub(_spelled, text)
    return f" {_BETWEEN.sub(' ', text).strip()} ".replace("l", "i")


@dataclass
class Lexicon:
    """Terms and weights (a beginning as `` term``, a whole word as `` term ``), exceptions, and the curve."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 2.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        built = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            built.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            folded = fold(phrase)
            built.add_word(folded, (len(folded), None))
        built.make_automaton()
        return built


def weigh(folded: str, automaton: ahocorasick.Automaton) -> float:
    """Sum over words of the heaviest term, exception phrases left out."""
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        begin = end - length + 1
        if weight is None:
            spared.append((begin, end))
        elif weight > best.get(begin, -math.inf):
            best[begin] = weight
    if spared:
        best = {b: w for b, w in best.items() if not any(s <= b < e for s, e in spared)}
    return sum(best.values())


def features(texts: list[str], automaton: ahocorasick.Automaton) -> np.ndarray:
    """Per text: 1, log(1 + sum), the sum by the square root of the length in words, log length where anything matched."""
    rows = []
    for text in texts:
        folded = fold(text)
        total, words = (weigh(folded, automaton) if automaton else 0.0), folded.count(" ")
        rows.append((1.0, math.log1p(max(0.0, total)), total / math.sqrt(words), math.log(words) * (total > 0)))
    return np.array(rows, np.float64).reshape(len(rows), 4)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def beginnings(text: str, shortest: int = 3, longest: int = 9) -> set[str]:
    out = set()
    for word in set(fold(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(shortest, min(longest, len(word)) + 1))
    return out


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, sample: int = 16_000, terms: int = 4_000, support: int = 5, trust: float = 0.55) -> Lexicon:
    """A lexicon from the training fold: terms whose share of toxic documents is above ``trust`` at the 95 % bound."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    known = known.filter(F.pmod(crc_of_id(), F.lit(folds)) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = scratch.save(known, "labels")  # at most ``sample`` rows of two numbers
    rows = scratch.save(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y"), "rows")
    total = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    plain = Lexicon({f" {fold(w).strip()}": 3.0 for w in SEEDS})
    if not total.get(1) or not total.get(0):
        return plain

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 8_000_000):
            seen = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                seen[y].update(beginnings(text or ""))
            found = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), *(pa.array([seen[y][t] for t in found], pa.int64()) for y in (1, 0))], names=["term", "a", "b"]
            )

    counted = rows.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # the lower end of Wilson's interval for a of a + b
    n, z = F.col("a") + F.col("b"), 1.96
    share = F.col("a") / n
    bound = (share + z * z / (2 * n) - z * F.sqrt((share * (1 - share) + z * z / (4 * n)) / n)) / (1 + z * z / n)
    found = (
        counted.filter(F.col("a") >= support).withColumn("bound", bound).filter(F.col("bound") >= trust)
        .orderBy(F.col("bound").desc(), F.col("a").desc(), "term").limit(terms).collect()
    )
    odds = math.log(total[1] / total[0])
    weights = {r["term"]: math.log((r["a"] + 0.5) / (r["b"] + 0.5)) - odds for r in found}
    # of a beginning and a longer term in nearly the same documents, the longer says more exactly what is meant
    holds = {r["term"]: r["a"] for r in found}
    for term in sorted(holds, key=len):
        for n in range(4, len(term)):
            if holds.get(term[:n], 0) and holds[term] >= 0.9 * holds[term[:n]]:
                weights.pop(term[:n], None)
    chosen = {t: w for t, w in weights.items() if not any(weights.get(t[:n], -math.inf) >= w for n in range(3, len(t)))}
    seen = {r["term"] for r in counted.filter(F.col("term").isin(*plain.terms) & (F.col("a") + F.col("b") >= support)).collect()}
    lexicon = Lexicon({t: w for t, w in plain.terms.items() if t not in seen} | chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in by_bytes(batches, "text", 8_000_000):
            x = features([t or "" for t in batch.column("text").to_pylist()], automaton)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [batch.column("y")], names=["x0", "x1", "x2", "x3", "y"])

    measured = rows.mapInArrow(measure, "x0 double, x1 double, x2 double, x3 double, y int").collect()
    table = np.array(measured, np.float64)
    scratch.drop("rows", "labels")
    lexicon.curve = tuple(map(float, fit(table[:, :4], table[:, 4])))
    return lexicon


def score(df: DataFrame, lexicon: Lexicon, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in by_bytes(batches, "text", 8_000_000):
            p = sigmoid(features([t or "" for t in batch.column("text").to_pylist()], automaton) @ curve)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", (F.pmod(crc_of_id(), F.lit(folds)) == 0).alias("held_out"), "score", "predicted")


def clean(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose score is under one half, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in by_bytes(batches, "text", 8_000_000):
            p = sigmoid(features([t or "" for t in batch.column("text").to_pylist()], automaton) @ curve)
            yield batch.filter(pa.array(p < 0.5))

    return df.mapInArrow(run, df.schema)
