"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch lie end to end in one numpy array of symbols.  In every
round each sequence finds the lowest rank among its adjacent pairs and all its
pairs of that rank are merged, left to right, for all sequences at once; a
sequence with no ranked pair left is done and its surviving symbols are
counted.  Equal units of a batch are merged once.

Null texts count as empty, an empty text has no tokens, ties cannot occur
(ranks are unique), repeated rows are counted each, extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

# The pre-tokenizer's published pattern and Unicode White_Space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

NEVER = np.int32(2**31 - 1)


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


@dataclass
class Merges:
    """A byte-level BPE vocabulary as arrays."""

    first: np.ndarray  # symbol of each byte
    keys: np.ndarray  # left * 2^17 + right, sorted
    ranks: np.ndarray  # rank of each key
    made: np.ndarray  # symbol made by each rank
    special: list[str]

    @classmethod
    def load(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab, merges = whole["model"]["vocab"], whole["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] * 2**17 + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(
            np.array([vocab[c] for _, c in sorted(byte_alphabet().items())], np.int64),
            keys[order],
            order.astype(np.int32),
            np.array([vocab[a + b] for a, b in pairs], np.int64),
            [t["content"] for t in whole["added_tokens"] if not t["normalized"]],
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * 2**17 + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols each byte sequence has after all merges."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = lengths.copy()
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        alive = np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        lengths = lengths[alive]
        ranks = None
        while len(alive):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            if ranks is None:
                ranks = np.full(len(symbols), NEVER, np.int32)
                ranks[:-1] = self.rank(symbols[:-1], symbols[1:])
                ranks[starts[1:] - 1] = NEVER
            low = np.minimum.reduceat(ranks, starts)
            going = low < NEVER
            if not going.all():
                counts[alive[~going]] = lengths[~going]
                stays = np.repeat(going, lengths)
                symbols, ranks = symbols[stays], ranks[stays]
                alive, lengths, low = alive[going], lengths[going], low[going]
                if not len(alive):
                    break
            hit = np.flatnonzero(ranks == np.repeat(low, lengths))
            # of pairs that overlap, as in aaa, every second one from the left
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            run = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbols[hit] = self.made[ranks[hit]]
            sequence = np.repeat(np.arange(len(alive)), lengths)
            lengths = lengths - np.bincount(sequence[hit], minlength=len(alive))
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbols, ranks = symbols[keep], ranks[keep]
            # only pairs that touch a new symbol have new ranks
            now = place[hit]
            ends = np.zeros(len(symbols), bool)
            ends[np.cumsum(lengths) - 1] = True
            near = np.zeros(len(symbols), bool)
            near[now] = near[now[now > 0] - 1] = True
            touched = np.flatnonzero(near)
            inner = touched[~ends[touched]]
            ranks[touched] = NEVER
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        return counts


class Counter:
    """Counts tokens of texts; remembers a bounded number of units."""

    def __init__(self, merges: Merges, remembered: int = 300_000):
        self.merges, self.remembered = merges, remembered
        self.known: dict[str, int] = {}
        # a unit is a run without white space and the blank before it, or what
        # the pattern makes of white space alone; the pattern never matches
        # across its border
        self.unit = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.pretoken = regex.compile(PRETOKEN).findall
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.known]
        if not fresh:
            return
        if len(self.known) + len(fresh) > self.remembered:
            self.known = {}
            fresh = list(units)
        parts: dict[str, int] = {}
        shape, owners = [], []
        for i, unit in enumerate(fresh):
            for p in (unit,) if unit[unit[0] == " " :].isalpha() else self.pretoken(unit):
                shape.append(parts.setdefault(p, len(parts)))
                owners.append(i)
        counts = self.merges.surviving([p.encode() for p in parts])
        total = np.bincount(owners, weights=counts[shape], minlength=len(fresh)).astype(np.int64)
        self.known.update(zip(fresh, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        rows = []
        for text in texts:
            spans = self.special.split(text) if self.special and self.special.search(text) else [text]
            rows.append((len(spans) - 1, [u for s in spans for u in self.unit(s)] if len(spans) > 1 else self.unit(text)))
        self.learn({u for _, units in rows for u in units})
        get = self.known.__getitem__
        return [extra + sum(map(get, units)) for extra, units in rows]


def count_tokens(df: DataFrame, model_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 4_000_000) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens and whether n_tokens passes ``limit``.

    ``model_path`` is read by the driver alone; its arrays (bounded by the
    vocabulary) travel with the task.
    """
    merges = Merges.load(model_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges)
        for batch in by_bytes(batches, "text", batch_bytes):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            tokens = counter.count(texts)
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
