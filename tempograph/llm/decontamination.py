"""Benchmark passages in documents, by q-gram lemma filtering.

Both sides are lower-cased and everything between words becomes one blank.  An
item of m bytes found with at most e edits shares at least m - q + 1 - q * e of
its q-grams with the place where it lies, on diagonals that differ by e at
most.  Shared q-grams are counted in diagonal bands e + 1 wide; any two
neighbouring bands are taken together, so every such set of diagonals lies in
one of these overlapping pairs.  Pairs that reach the bound are verified by
alignment inside the band.

e is a share of m (``rate``), and never so large that the bound would fall
under one.  Items shorter than q are matched nowhere.  Null texts and items
count as empty and match nothing; equal items all match; repeated documents
each get their rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes

Q = 8
_BETWEEN = re.compile(r"[\W_]+")


def normalised(text: str | None) -> bytes:
    return _BETWEEN.sub(" ", (text or "").lower()).strip().encode("utf-8", "replace")


def grams(data: np.ndarray) -> np.ndarray:
    """The Q bytes from each position as one number."""
    n = len(data) - Q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(Q if n > 0 else 0):
        out |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 20)


def budget(m: int, rate: float) -> int:
    return min(int(rate * m), (m - Q) // Q)


@dataclass
class Index:
    """The q-grams of a block of items with their places."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    bound: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    #: no shorter than any item, so that diagonals count from above zero
    above: int

    @classmethod
    def build(cls, items: list[tuple], rate: float) -> Index:
        pairs = [(i, t) for i, raw in items if len(t := normalised(raw)) >= Q]
        texts = [t for _, t in pairs]
        edits = np.array([budget(len(t), rate) for t in texts], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        each = [grams(np.frombuffer(t, np.uint8)) for t in texts]
        gram = np.concatenate(each) if each else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(texts)), lengths - Q + 1)
        place = np.concatenate([np.arange(len(g)) for g in each]) if each else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        keys, first = np.unique(gram[order], return_index=True)
        seen = np.zeros(1 << 20, bool)
        seen[_slot(keys)] = True
        return cls([i for i, _ in pairs], texts, edits, lengths - Q + 1 - Q * edits, keys, np.append(first, len(gram)), item[order], place[order], seen, max(map(len, texts), default=0))

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, begin, end): the best place of each item in each text."""
        if not len(self.keys):
            return []
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        gram = grams(data)
        at = np.flatnonzero(self.seen[_slot(gram)])
        where = np.minimum(np.searchsorted(self.keys, gram[at]), len(self.keys) - 1)
        real = self.keys[where] == gram[at]
        at, where = at[real], where[real]
        times = self.first[where + 1] - self.first[where]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        hit = np.repeat(self.first[where], times) + nth
        item = self.item[hit]
        wide = self.edits[item] + 1
        band = (np.repeat(at, times) - self.place[hit] + self.above) // wide
        key = item * np.int64(1 << 40) + band
        # a place of the item counts once in a band, however often the text repeats it
        order = np.lexsort((self.place[hit], key))
        key, place = key[order], self.place[hit][order]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (place[1:] != place[:-1]))) if len(key) else np.zeros(0, bool)
        key = key[once]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        key, count = key[new], np.diff(np.append(new, len(key)))
        both = count.copy()
        follows = np.flatnonzero(key[1:] == key[:-1] + 1) if len(key) else new
        both[follows] += count[follows + 1]
        item = key >> 40
        # a band whose neighbour below is empty begins a pair, too
        passing = np.flatnonzero(both >= self.bound[item])
        ends = np.cumsum([len(t) + 1 for t in texts])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in passing.tolist():
            i, b = int(item[k]), int(key[k] & ((1 << 40) - 1))
            e, m = int(self.edits[i]), len(self.texts[i])
            low = b * (e + 1) - self.above - e
            high = low + 2 * (e + 1) - 1 + 2 * e
            begin, end = max(0, low), min(len(joined), high + m)
            for t in range(int(np.searchsorted(ends, begin, side="right")), len(texts)):
                start = int(ends[t]) - len(texts[t]) - 1
                if start >= end:
                    break
                a, z = max(begin, start), min(end, start + len(texts[t]))
                if z - a < m - e or best.get((t, i), (e + 1,))[0] == 0:
                    continue
                found = place_of(self.texts[i], joined[a:z], a, low, high, e)
                if found and found[0] < best.get((t, i), (e + 1,))[0]:
                    best[t, i] = (found[0], found[1] - start, found[2] - start)
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def place_of(item: bytes, region: bytes, offset: int, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the best alignment of the whole item inside the region on diagonals low to high."""
    at = region.find(item)
    if at >= 0:
        return 0, offset + at, offset + at + len(item)
    if most == 0:
        return None
    far = 1 << 20
    wide = high - low + 2
    # the region with the positions before and after it that the band touches, which match nothing
    text = np.full(wide + len(item) + 1, 256, np.int16)
    first = offset - low
    begin, end = max(0, first), min(len(text), first + len(region))
    text[begin:end] = np.frombuffer(region, np.uint8)[begin - first : end - first]
    steps = np.arange(wide)
    # cell (j, d): j bytes of the item aligned, text position low + d + j
    cost = np.where((steps >= first) & (steps <= first + len(region)), 0, far)
    skip = np.full(wide, far)
    rows = [cost]
    for j, byte in enumerate(item):
        np.add(cost[1:], 1, out=skip[:-1])
        through = cost + (text[j : j + wide] != byte)
        # the last: bytes of the text that the item lacks
        cost = np.minimum.accumulate(np.minimum(through, skip) - steps) + steps
        cost[max(0, first + len(region) - j) :] = far
        if first - j - 1 > 0:
            cost[: first - j - 1] = far
        if cost.min() > most:
            return None
        rows.append(cost)
    d = last = int(cost.argmin())
    edits = int(cost[d])
    for j in range(len(item), 0, -1):  # back to where the item begins
        while True:
            now = rows[j][d]
            if now == rows[j - 1][d] + (text[j - 1 + d] != item[j - 1]):
                break
            if d + 1 < wide and now == rows[j - 1][d + 1] + 1:
                d += 1
                break
            d -= 1
    return edits, low + d, low + last + len(item)


def contaminated(df: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4_000_000, batch_bytes: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, edits, begin, end) of every benchmark item in every document.

    The benchmark is taken in blocks of about ``block_bytes``, one scan of the
    documents each.  Where there are several, what a block finds is written
    before the next one is read, so that the driver and a task hold one block.
    Places are byte offsets in the normalised document.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    scratch = Scratch(df.sparkSession, "contaminated")
    doc_kind, item_kind = df.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = Index.build([(r["item_id"], r["text"]) for r in own.collect()], rate)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", batch_bytes):
                found = index.find([normalised(t) for t in batch.column("text").to_pylist()])
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array([f[0] for f in found], pa.int64())),
                        pa.array([index.ids[f[1]] for f in found], benchmark_type),
                        pa.array([f[2] for f in found], pa.int32()),
                        pa.array([f[3] for f in found], pa.int64()),
                        pa.array([f[4] for f in found], pa.int64()),
                    ],
                    names=["doc_id", "item_id", "edits", "begin", "end"],
                )

        benchmark_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
        part = df.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, edits int, begin long, `end` long")
        if blocks > 1:
            part = scratch.save(part, f"block-{b}")
        out = part if out is None else out.union(part)
    return out


def decontaminated(df: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4_000_000, batch_bytes: int = 1_000_000) -> DataFrame:
    """The rows in whose text no benchmark item was found, with all their columns.

    Each row is judged by its own text, whatever its id.  The benchmark is taken
    in blocks as in ``contaminated``; what a block leaves is written for the next.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    scratch = Scratch(df.sparkSession, "decontaminated")
    for b in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        index = Index.build([(r["item_id"], r["text"]) for r in own.collect()], rate)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in by_bytes(batches, "text", batch_bytes):
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in index.find([normalised(t) for t in batch.column("text").to_pylist()])]] = False
                yield batch.filter(pa.array(clean))

        df = df.mapInArrow(run, df.schema)
        if b < blocks - 1:
            df = scratch.save(df, f"block-{b}")
            if b:
                scratch.drop(f"block-{b - 1}")
    return df
