"""Brown class-based bigram scores.

P(text) is the product over its tokens, the end last, of
P(class | class before) * P(word | class).  Classes come from exchange
clustering of the whole training vocabulary: a word moves to the class that
raises the likelihood of the class bigrams the most.

The ``core`` most frequent words seed the classes: the driver exchanges them
one at a time, on their bigrams of the whole corpus, until none moves or
``seeding`` sweeps are over.  Then come sweeps over every training word, the
core's again: the first gives each word without a class one, the next
``sweeps`` move words on.  A sweep sends each word's counts beside the current
classes to the part that owns the word; a part takes its words from frequent to
rare, a block at a time, and sees its own moves at once and those of other
parts in the next sweep, when the class bigrams are counted anew.  It ends when
no word moves; a sweep that lowers the likelihood (parts moved at cross
purposes) is not taken and ends it too.  All words, whatever their count, move
by the same rule.

Emissions are discounted by what words seen once and twice say (d = n1 / (n1 +
2 n2) of the class); the discounts go to the one event "a word that training
lacks".  After such a word the class before it stands.  Transitions lean on
the class frequencies.  All probabilities of a place sum to one.

Texts are packed into chunks with a dictionary each, bucketed by chunk.  Words
are counted by hash range, from one row per chunk and range, so the most
frequent word costs its reducer one entry per chunk; answers go back to the
chunks.  The driver holds the core's bigrams and the class tables only, whose
size the parameters bound.

Null texts count as empty: one token, the end.  Null ids are in the fold of
remainder 0.  Equal rows count each.  Without training texts nothing is known,
the base is 0 for each token and the score equals it.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, crc_of_id, parallelism, save_bucketed

ADDED = 0.1
SMALL = 6  # counts up to here go through tables


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(_unpack(data), kind)


def tokenised(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words of all texts and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(sizes)), sizes)
    kept = real.to_numpy(zero_copy_only=False)
    return flat.filter(real), np.bincount(owner[kept], minlength=len(sizes))


# ---- exchange clustering


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


def exchange(bigrams: np.ndarray, classes: int, fixed: int, sweeps: int) -> np.ndarray:
    """Classes of the core's words, exchanged one at a time until none moves or the sweeps are over.

    ``bigrams`` counts word pairs; its last ``fixed`` rows and columns are
    classes of their own that never move (the end, and all words outside).
    """
    words = len(bigrams) - fixed
    where = np.concatenate([np.arange(words) % classes, classes + np.arange(fixed)])
    total = classes + fixed
    # counts of each word beside each class, kept exact as words move
    after, before = np.zeros((len(bigrams), total)), np.zeros((total, len(bigrams)))
    for c in range(total):
        after[:, c] = bigrams[:, where == c].sum(1)
        before[c] = bigrams[where == c].sum(0)
    table = np.stack([after[where == c].sum(0) for c in range(total)])
    out, into = table.sum(1), table.sum(0)
    own = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            a, self_ = where[w], float(bigrams[w, w])
            s, p = after[w].copy(), before[:, w].copy()
            s[a] -= self_
            p[a] -= self_
            n_out, n_in = s.sum() + self_, p.sum() + self_
            if n_out + n_in == 0:
                continue
            table[a] -= s
            table[:, a] -= p
            table[a, a] -= self_
            out[a] -= n_out
            into[a] -= n_in
            at_s, at_p = np.flatnonzero(s), np.flatnonzero(p)
            row, col = table[:classes][:, at_s], table[at_p][:, :classes]
            gain = (_plogp(row + s[at_s]) - _plogp(row)).sum(1) + (_plogp(col + p[at_p, None]) - _plogp(col)).sum(0)
            corner = table[own, own]
            sb, pb = s[:classes], p[:classes]
            gain += _plogp(corner + sb + pb + self_) - _plogp(corner + sb) - _plogp(corner + pb) + _plogp(corner)
            gain -= _plogp(out[:classes] + n_out) - _plogp(out[:classes]) + _plogp(into[:classes] + n_in) - _plogp(into[:classes])
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += s
            table[:, b] += p
            table[b, b] += self_
            out[b] += n_out
            into[b] += n_in
            if b != a:
                moved += 1
                where[w] = b
                after[:, a] -= bigrams[:, w]
                after[:, b] += bigrams[:, w]
                before[a] -= bigrams[w]
                before[b] += bigrams[w]
        if not moved:
            break
    return where


def likelihood(table: np.ndarray) -> float:
    """What the class bigrams add to the log likelihood of the corpus; the rest of it does not depend on classes."""
    return float(_plogp(table).sum() - _plogp(table.sum(0)).sum() - _plogp(table.sum(1)).sum())


def gains(table: np.ndarray, after: np.ndarray, before: np.ndarray, own: np.ndarray, where: np.ndarray, classes: int) -> np.ndarray:
    """Gain in likelihood of each word (row) in each class, against the word taken out of the class that it is in.

    ``table`` counts class pairs, ``after`` and ``before`` the classes that
    follow and precede each word, less the ``own`` times that it follows itself.
    """
    p0 = _plogp(table)
    out, into = table.sum(1), table.sum(0)
    gain = np.zeros((len(where), classes))
    s, p = after[:, :classes], before[:, :classes]
    inside = np.flatnonzero(where < classes)
    stay = np.zeros(len(where))
    for counts, gone, beside, size in ((after, p, table, out), (before, s, table.T, into)):
        # what enters a class, cell by cell: small counts by tables of one product each, others one by one
        cells, known = beside[:classes].T, _plogp(beside[:classes].T)
        for n in range(1, SMALL + 1):
            these = counts == n
            if these.any():
                gain += these.astype(np.float64) @ (_plogp(cells + n) - known)
        word, at = np.nonzero(counts > SMALL)
        for i in range(0, len(word), 20_000):
            w, c = word[i : i + 20_000], at[i : i + 20_000]
            step = _plogp(cells[c] + counts[w, c][:, None]) - known[c]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
            gain[w[first]] += np.add.reduceat(step, first)
        # a word leaves the cells of its own class before it enters another one
        own_cell = counts[np.arange(len(where)), where]
        w, c = np.nonzero((own_cell > 0)[:, None] & (gone > 0))
        n, cell, less = own_cell[w], cells[where[w], c], gone[w, c]
        gain[w, c] += _plogp(cell - less + n) - _plogp(cell - less) - _plogp(cell + n) + _plogp(cell)
        # the class as a whole; many words have the same few counts
        total = counts.sum(1) + own
        few, which = np.unique(total, return_inverse=True)
        gain -= (_plogp(size[:classes] + few[:, None]) - _plogp(size[:classes]))[which]
        # in the class that it is in, the cells already hold it
        w, c = np.nonzero(counts)
        a = where[w]
        there = (a < classes) & (c != a)
        w, c, a = w[there], c[there], a[there]
        stay += np.bincount(w, _plogp(beside[a, c]) - _plogp(beside[a, c] - counts[w, c]), len(where))
        a = where[inside]
        stay[inside] -= _plogp(size[a]) - _plogp(size[a] - total[inside])
    corner = np.diagonal(table)[:classes]
    w, c = np.nonzero(((s > 0) & (p > 0)) | (own > 0)[:, None])
    gain[w, c] += _plogp(corner[c] + s[w, c] + p[w, c] + own[w]) - _plogp(corner[c] + s[w, c]) - _plogp(corner[c] + p[w, c]) + _plogp(corner[c])
    a = where[inside]
    stay[inside] += p0[a, a] - _plogp(table[a, a] - after[inside, a] - before[inside, a] - own[inside])
    gain[inside, a] = stay[inside]
    return gain


def moves(table: np.ndarray, beside: Callable[[int, int], np.ndarray], where: np.ndarray, classes: int) -> np.ndarray:
    """Classes of words, the most frequent first, after each had its move; ``table`` follows the moves.

    ``beside(a, z)`` gives the words' counts: classes after, classes before, itself.
    """
    where = where.copy()
    wide = len(table)
    a, size = 0, 16
    while a < len(where):
        z = min(len(where), a + size)
        counts = beside(a, z).astype(np.float64)
        after, before, own = counts[:, :wide], counts[:, wide : 2 * wide], counts[:, 2 * wide]
        old, rows = where[a:z], np.arange(z - a)
        after[rows, old] -= own
        before[rows, old] -= own
        gain = gains(table, after, before, own, old, classes)
        new = gain.argmax(1)
        inside = old < classes
        stays = inside & (gain[rows, new] <= gain[rows, np.minimum(old, classes - 1)] + 1e-9)
        new = np.where(stays, old, new)
        w = np.flatnonzero(new != old)
        # whole numbers: sums are exact in any order
        change = np.zeros((wide, len(w)))
        change[new[w], np.arange(len(w))] = 1.0
        change[old[w], np.arange(len(w))] -= 1.0
        table += change @ after[w]
        table += (change @ before[w]).T
        for to, sign in ((old[w], -1.0), (new[w], 1.0)):
            table[np.arange(wide), np.arange(wide)] += sign * np.bincount(to, own[w], wide)
        np.maximum(table, 0.0, out=table)
        where[a:z] = new
        a, size = z, min(2 * size, 2048)
    return where


# ---- chunks

CHUNKS = "chunk long, ids array<bigint>, held binary, lengths binary, tokens binary, words binary, digests binary, seen binary, bytes long"


def _encode(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of about ``chunk_bytes`` of text: tokens as numbers of a dictionary that the row holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for made, batch in enumerate(by_bytes(batches, "text", chunk_bytes)):
            words, lengths = tokenised(batch.column("text"))
            coded = words.dictionary_encode()
            tokens = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            distinct = len(coded.dictionary)
            order = np.argsort(-np.bincount(tokens, minlength=distinct), kind="stable")
            rank = np.empty(distinct, np.int64)
            rank[order] = np.arange(distinct)
            tokens = rank[tokens]
            seen = np.bincount(tokens[np.repeat(~held, lengths)], minlength=distinct)
            words = list(map(str.encode, coded.dictionary.take(pa.array(order)).to_pylist()))
            row = {
                "chunk": task << 32 | made,
                "ids": batch.column("id").to_pylist(),
                "held": np.packbits(held).tobytes(),
                "lengths": _pack(lengths.astype(np.int32).tobytes()),
                "tokens": _pack(tokens.astype(np.uint32).tobytes()),
                "words": _pack(b"\n".join(words)),
                "digests": np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, distinct).tobytes(),
                "seen": _pack(seen.astype(np.int32).tobytes()),
                "bytes": pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0,
            }
            kinds = [pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * 6 + [pa.int64()]
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(list(zip(row, kinds, strict=True))))

    return df.mapInArrow(run, CHUNKS)


class Chunk:
    def __init__(self, row: dict):
        self.row = row
        self.lengths = _numbers(row["lengths"], np.int32).astype(np.int64)
        self.tokens = _numbers(row["tokens"], np.uint32).astype(np.int64)
        self.held = np.unpackbits(np.frombuffer(row["held"], np.uint8), count=len(self.lengths)).astype(bool)
        joined = _unpack(row["words"]) if "words" in row else b""
        self.words = joined.split(b"\n") if joined else []
        self.seen = _numbers(row["seen"], np.int32)
        self.distinct = len(self.seen)

    def parts(self, parts: int) -> np.ndarray:
        return np.frombuffer(self.row["digests"], np.uint32) % np.uint32(parts)

    def placed(self, part: dict[int, np.ndarray], column: str, name: str, kind: type, otherwise: int) -> np.ndarray:
        """What came back for each word of the dictionary, by its part."""
        out = np.full(self.distinct, otherwise, np.int64)
        for m in self.row[column] or []:
            out[part[m["part"]]] = _numbers(m[name], kind)
        return out

    def stream(self, values: np.ndarray, end: int, train_only: bool) -> np.ndarray:
        """Values of the tokens, an end before the first and after each text."""
        use = ~self.held if train_only else np.ones(len(self.held), bool)
        tokens, lengths = self.tokens[np.repeat(use, self.lengths)], self.lengths[use]
        out = np.full(len(tokens) + len(lengths) + 1, end, np.int64)
        place = np.arange(len(tokens)) + np.repeat(np.arange(len(lengths)), lengths) + 1
        out[place] = values[tokens]
        return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Chunk({n: batch.column(n)[i].as_py() for n in batch.schema.names})


def _grouped(index: np.ndarray) -> list[tuple[int, np.ndarray]]:
    if not len(index):
        return []
    most = int(index.max())
    order = np.argsort(index.astype(np.uint16) if most < 1 << 16 else index, kind="stable")  # short numbers are sorted by radix
    sizes = np.bincount(index, minlength=most + 1)
    used = np.flatnonzero(sizes)
    return list(zip(used.tolist(), np.split(order, np.cumsum(sizes[used])[:-1]), strict=True))


# ---- counts of words


def _count(chunks: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            known = np.flatnonzero(c.seen > 0)
            rows = [
                {"part": p, "words": _pack(b"\n".join([c.words[i] for i in known[own].tolist()])), "counts": _pack(c.seen[known[own]].astype(np.int64).tobytes())}
                for p, own in _grouped(c.parts(parts)[known])
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))

    return chunks.select("chunk", "held", "lengths", "tokens", "words", "digests", "seen").mapInArrow(run, "part int, words binary, counts binary")


def _merged_words(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray, list[int]]:
    """Distinct words of several lists, the number of each entry's word, and the lists' lengths."""
    lists = [_listed(_unpack(b)) for b in blobs]
    coded = pa.chunked_array(lists, pa.large_binary()).combine_chunks().dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), [len(x) for x in lists]


def _listed(joined: bytes) -> pa.Array:
    """Words that lines hold, as Arrow has them: all bytes but the ends of lines, and where each word begins."""
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data == 10)
    offsets = np.concatenate(([0], ends - np.arange(len(ends)), [len(data) - len(ends)])).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


TOP = "part int, words binary, counts binary"


def _frequent(core: int):
    """The most frequent words of the lists of a group, as one list."""

    def top(table: pa.Table) -> pa.Table:
        words, which, _ = _merged_words(table.column("words").to_pylist())
        counts = np.concatenate([_numbers(b, np.int64) for b in table.column("counts").to_pylist()])
        total = np.bincount(which, counts, len(words)).astype(np.int64)
        # only words as frequent as the last one wanted are put in order
        some = np.flatnonzero(total >= np.partition(total, len(total) - core)[len(total) - core]) if core < len(total) else np.arange(len(total))
        order = pc.sort_indices(pa.table({"n": total[some], "w": words.take(pa.array(some))}), sort_keys=[("n", "descending"), ("w", "ascending")])
        first = some[order.to_numpy()[:core]]
        row = {"part": table.column("part")[0].as_py(), "words": _pack(b"\n".join(words.take(pa.array(first)).to_pylist())), "counts": _pack(total[first].tobytes())}
        return pa.Table.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))

    return top


def _core(counted: DataFrame, parts: int, core: int) -> list[bytes]:
    """The ``core`` most frequent words: one list per part, then per some parts, then here."""
    top = _frequent(core)
    groups = math.isqrt(parts) + 1
    lists = counted.groupBy("part").applyInArrow(top, TOP)
    lists = lists.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("part").applyInArrow(top, TOP).collect()
    if not lists:
        return []
    table = pa.Table.from_pylist([{"part": 0, "words": bytes(r["words"]), "counts": bytes(r["counts"])} for r in lists])
    joined = _unpack(top(table).column("words")[0].as_py())
    return joined.split(b"\n") if joined else []


# ---- class counts


def _bigrams(chunks: DataFrame, core: list[bytes], blocks: int = 32) -> np.ndarray:
    """Counts of pairs among the core, the end and all words outside, over the training texts."""
    number = {w: i for i, w in enumerate(core)}
    wide = len(core) + 2
    schema = pa.schema([("block", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []

        def fold() -> tuple[np.ndarray, np.ndarray]:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (cells[:0], counts[:0])
            both, where = np.unique(np.concatenate([cells, found]), return_inverse=True)
            return both, np.bincount(where, np.concatenate([counts, n]), len(both)).astype(np.int64)

        for c in _chunks(batches):
            value = np.fromiter((number.get(w, wide - 1) for w in c.words), np.int64, len(c.words))
            line = c.stream(value, wide - 2, True)
            held.append(line[:-1] * wide + line[1:])
            if len(held) == 4:
                cells, counts = fold()
                held = []
        cells, counts = fold()
        rows = [{"block": b, "cells": _pack(cells[own].astype(np.uint32).tobytes()), "counts": _pack(counts[own].tobytes())} for b, own in _grouped(cells % blocks)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    def add(table: pa.Table) -> pa.Table:
        cells = np.concatenate([_numbers(b, np.uint32) for b in table.column("cells").to_pylist()])
        counts = np.concatenate([_numbers(b, np.int64) for b in table.column("counts").to_pylist()])
        both, where = np.unique(cells, return_inverse=True)
        total = np.bincount(where, counts, len(both)).astype(np.int64)
        return pa.table({"cells": pa.array([_pack(both.tobytes())], pa.binary()), "counts": pa.array([_pack(total.tobytes())], pa.binary())})

    source = chunks.select("held", "lengths", "tokens", "words", "seen")
    out = np.zeros(wide * wide, np.int64)
    for r in source.mapInArrow(run, "block int, cells binary, counts binary").groupBy("block").applyInArrow(add, "cells binary, counts binary").collect():
        out[_numbers(bytes(r["cells"]), np.uint32)] += _numbers(bytes(r["counts"]), np.int64)
    return out.reshape(wide, wide)


SENT = ("names", "seen", "classes", "rows", "cells", "counts")


def _beside(chunks: DataFrame, classes: int, parts: int, named: dict[bytes, int] | None = None) -> DataFrame:
    """(part, chunk, names, ...): each chunk's words by range, with their classes and their counts beside the classes.

    In the first sweep ``named`` gives the classes, other words are outside, and
    names are the words themselves; then both are what came back to the chunk,
    the classes and the words' numbers in their parts.
    """
    end, outside = classes, classes + 1
    wide = 2 * (classes + 2) + 1
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64())] + [(n, pa.binary()) for n in SENT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            part = dict(_grouped(c.parts(parts)))
            if named is None:
                value, number = c.placed(part, "moved", "classes", np.int16, -1), c.placed(part, "marks", "numbers", np.uint32, 0)
            else:
                value = np.fromiter((named.get(w, outside) for w in c.words), np.int64, len(c.words))
            value = np.where(c.seen > 0, value, -1)
            line = c.stream(value, end, True)
            word = c.stream(np.arange(c.distinct), -1, True)
            at = np.flatnonzero(word >= 0)
            again = at[word[at - 1] == word[at]]
            # words in the order of their parts, so that a part's cells lie side by side
            order = np.concatenate(list(part.values())) if part else np.zeros(0, np.int64)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            key = np.concatenate([place[word[at]] * wide + line[at + 1], place[word[at]] * wide + classes + 2 + line[at - 1], place[word[again]] * wide + wide - 1])
            if c.distinct * wide <= 1 << 24:
                n = np.bincount(key, minlength=c.distinct * wide)
                key = np.flatnonzero(n)
                n = n[key]
            else:
                key, n = np.unique(key, return_counts=True)
            owner, cell = key // wide, key % wide
            rows, first = [], 0
            for p, own in part.items():
                lo, hi = np.searchsorted(owner, (first, first + len(own)))
                rows.append(
                    {
                        "part": p,
                        "chunk": c.row["chunk"],
                        "names": _pack(b"\n".join([c.words[i] for i in own.tolist()]) if named is not None else number[own].astype(np.uint32).tobytes()),
                        "seen": _pack(c.seen[own].tobytes()),
                        "classes": _pack(value[own].astype(np.int16).tobytes()),
                        "rows": _pack(np.bincount(owner[lo:hi] - first, minlength=len(own)).astype(np.uint16).tobytes()),
                        "cells": _pack(cell[lo:hi].astype(np.uint8 if wide <= 256 else np.uint16).tobytes()),
                        "counts": _pack(_small(n[lo:hi])),
                    }
                )
                first += len(own)
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    columns = ["chunk", "held", "lengths", "tokens", "digests", "seen"] + (["words"] if named is not None else ["marks", "moved"])
    return chunks.select(*columns).mapInArrow(run, "part int, chunk long, " + ", ".join(f"{n} binary" for n in SENT))


def _small(n: np.ndarray) -> bytes:
    """Numbers from 1, nearly all small, as bytes: those over 254 are 255 here and stand in full behind."""
    head = np.minimum(n, 255).astype(np.uint8).tobytes()
    return np.uint32(len(n)).tobytes() + head + n[n > 254].astype(np.int64).tobytes()


def _from_small(data: bytes) -> np.ndarray:
    size = int(np.frombuffer(data, np.uint32, 1)[0])
    n = np.frombuffer(data, np.uint8, size, 4).astype(np.int64)
    n[n == 255] = np.frombuffer(data, np.int64, -1, 4 + size) if (n == 255).any() else 0
    return n


def _move(table: np.ndarray, classes: int, first: bool):
    """Class of each word after its move, sent back to the chunks, and sums of each class; counts and numbers too the first time.

    A word's number is its place in its part by count, then by the word itself,
    so that the order of rows does not matter.
    """
    half = classes + 2
    wide = 2 * half + 1

    def move(rows: pa.Table) -> pa.Table:
        columns = {n: rows.column(n).to_pylist() for n in SENT}
        seen = [_numbers(b, np.int32) for b in columns["seen"]]
        sizes = [len(x) for x in seen]
        if first:
            words, which, _ = _merged_words(columns["names"])
            total = np.bincount(which, np.concatenate(seen), len(words)).astype(np.int64)
            order = pc.sort_indices(pa.table({"n": total, "w": words}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            which, total = rank[which], total[order]
            del words
        else:
            which = np.concatenate([_numbers(b, np.uint32) for b in columns["names"]]).astype(np.int64)
            total = np.bincount(which, np.concatenate(seen)).astype(np.int64)
        known = int(np.count_nonzero(total))
        each = np.concatenate([_numbers(b, np.uint16) for b in columns["rows"]]).astype(np.int64)
        owner = np.repeat(which, each)
        cells = np.concatenate([_numbers(b, np.uint8 if wide <= 256 else np.uint16) for b in columns["cells"]]).astype(np.int64)
        counts = np.concatenate([_from_small(_unpack(b)) for b in columns["counts"]])
        given = np.concatenate([_numbers(b, np.int16) for b in columns["classes"]])
        where = np.full(len(total), -1, np.int64)
        where[which[given >= 0]] = given[given >= 0]
        order = np.argsort(owner, kind="stable")
        owner, cells, counts = owner[order], cells[order], counts[order]

        def beside(a: int, z: int) -> np.ndarray:
            lo, hi = np.searchsorted(owner, (a, z))
            return np.bincount((owner[lo:hi] - a) * wide + cells[lo:hi], counts[lo:hi], (z - a) * wide).reshape(z - a, wide)

        after = moves(table.copy(), beside, where[:known], classes)
        moved = int((after != where[:known]).sum())
        where[:known] = after
        n = total[:known]
        sums = [np.bincount(after[m], w, classes).astype(np.int64) for m, w in ((slice(None), n), (slice(None), None), (n == 1, None), (n == 2, None))]
        ends = np.cumsum(sizes)
        spans = [which[e - k : e] for e, k in zip(ends, sizes, strict=True)]
        nothing = [b""] * len(spans)
        back = {
            "classes": [_pack(where[x].astype(np.int16).tobytes()) for x in spans],
            "counts": [_pack(total[x].tobytes()) for x in spans] if first else nothing,
            "numbers": [_pack(x.astype(np.uint32).tobytes()) for x in spans] if first else nothing,
        }
        head = {n: pa.concat_arrays([rows.column(n).combine_chunks(), end]) for n, end in (("chunk", pa.array([-1], pa.int64())), ("part", rows.column("part").combine_chunks()[:1]))}
        return pa.table(head | {n: pa.array([*v, np.append(np.concatenate(sums), moved).tobytes() if n == "classes" else b""], pa.binary()) for n, v in back.items()})

    return move


MOVED = "chunk long, part int, classes binary, counts binary, numbers binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes' sums of many parts, added up."""
    total = None
    for batch in batches:
        for raw in batch.column("classes").to_pylist():
            own = np.frombuffer(raw, np.int64)
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["cell", "n"])


def _known(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Count and class of each word of a chunk's dictionary."""
    part = dict(_grouped(c.parts(c.row["parts"]))) if c.distinct else {}
    return c.placed(part, "marks", "counts", np.int64, 0), c.placed(part, "moved", "classes", np.int16, -1)


def _transitions(marked: DataFrame, classes: int) -> np.ndarray:
    wide = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(wide * wide, np.int64)
        for c in _chunks(batches):
            part = dict(_grouped(c.parts(c.row["parts"]))) if c.distinct else {}
            line = c.stream(c.placed(part, "moved", "classes", np.int16, -1), classes, True)
            total += np.bincount(line[:-1] * wide + line[1:], minlength=wide * wide)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(wide * wide, np.int64)
    read = marked.select("held", "lengths", "tokens", "digests", "seen", "parts", "moved")
    for r in read.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(wide, wide)


class Model:
    """Logarithms to the base 10 of the transitions and emissions."""

    def __init__(self, bigrams: np.ndarray, tokens: np.ndarray, kinds: np.ndarray, once: np.ndarray, twice: np.ndarray, texts: int, lean: float = 5.0):
        classes = len(bigrams) - 1
        into = bigrams.sum(0) + 1.0
        share = into / into.sum()
        with np.errstate(divide="ignore"):
            self.step = np.log10((bigrams + lean * share) / (bigrams.sum(1, keepdims=True) + lean))
        self.discount = np.clip(once / np.maximum(once + 2.0 * twice, 1), 0.1, 0.9)
        self.of_class = tokens.astype(np.float64)
        spare = np.where(tokens > 0, self.discount * kinds / np.maximum(tokens, 1), 1.0)
        self.strange = np.log10(10 ** self.step[:, :classes] @ spare)
        self.train_tokens = int(tokens.sum()) + texts
        self.distinct = int(kinds.sum()) + (texts > 0)
        self.texts, self.end = texts, classes

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.train_tokens + ADDED * (self.distinct + 1)))

    def scored(self, line: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Log probabilities of all but the first of a line of classes, -1 for words without one."""
        last = np.maximum.accumulate(np.where(line >= 0, np.arange(len(line)), 0))
        before = line[last[:-1]]
        here = line[1:]
        return np.where(here >= 0, self.step[before, here] + emitted[1:], self.strange[before])


def _scores(marked: DataFrame, model: Model) -> DataFrame:
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            counts, classes = _known(c)
            emitted = np.zeros(len(counts))
            k = classes >= 0
            emitted[k] = np.log10((counts[k] - model.discount[classes[k]]) / model.of_class[classes[k]])
            line = c.stream(classes, model.end, False)
            index = c.stream(np.arange(len(counts)), len(counts), False)
            weight = np.append(emitted, 0.0)[index]
            base = model.base(np.append(counts, model.texts)[index[1:]])
            known = (np.append(counts, model.texts)[index[1:]] > 0).astype(np.int64)
            first = np.cumsum(c.lengths + 1) - (c.lengths + 1)
            base = np.add.reduceat(base, first)
            score = np.add.reduceat(model.scored(line, weight), first) if model.texts else base
            n = len(first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c.row["ids"], pa.int64()), pa.array(c.held), pa.array(c.lengths + 1), pa.array(np.add.reduceat(known, first)),
                    pa.array(np.full(n, model.train_tokens, np.int64)), pa.array(base), pa.array(score),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return marked.drop("words").mapInArrow(run, schema)


def fit(df: DataFrame, classes: int = 64, core: int = 2048, seeding: int = 8, sweeps: int = 3, folds: int = 10, chunk_bytes: int = 4_000_000, part_bytes: int = 24_000_000) -> tuple[DataFrame, Model]:
    """The chunks with the count and class of each of their words, and the model."""
    spark = df.sparkSession
    scratch = Scratch(spark, "classes")
    docs = df.select(F.col("doc_id").cast("long").alias("id"), "text", (F.pmod(crc_of_id(), F.lit(folds)) == 0).alias("held"))
    chunks = save_bucketed(scratch, _encode(docs, chunk_bytes), "chunks", "chunk")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(parallelism(spark), -(-total // part_bytes))
    chunks = chunks.withColumn("parts", F.lit(parts))
    frequent = _core(_count(chunks, parts), parts, core)
    pairs = _bigrams(chunks, frequent)
    where = exchange(pairs, classes, 2, seeding)
    named = dict(zip(frequent, where[: len(frequent)].tolist(), strict=True))
    texts = int(pairs[len(frequent)].sum())
    table = np.zeros((classes + 2, classes + 2))
    np.add.at(table, (where[:, None], where[None, :]), pairs)
    marked, best = chunks, None
    for k in range(sweeps + 1):
        sent = _beside(marked, classes, parts, None if k else named)
        moved = scratch.save(sent.groupBy("part").applyInArrow(_move(table, classes, not k), MOVED), f"moved-{k}")
        del sent
        sums = np.zeros(4 * classes + 1, np.int64)
        for r in moved.filter("chunk = -1").select("classes").mapInArrow(_summed, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
            sums[r["cell"]] = r["n"]
        back = moved.filter("chunk >= 0")
        if not k:
            # counts and numbers stay as they are; bucketed like the chunks, they are read in place by every sweep
            numbered = save_bucketed(scratch, back.groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "numbers")).alias("marks")), "marks", "chunk")
            chunks = chunks.join(numbered, "chunk", "left")
        own = save_bucketed(scratch, back.groupBy("chunk").agg(F.collect_list(F.struct("part", "classes")).alias("moved")), f"classes_{k}", "chunk")
        scratch.drop(f"moved-{k}")
        tried = chunks.join(own, "chunk", "left")
        bigrams = _transitions(tried, classes)
        found = likelihood(bigrams)
        # shuffles of past sweeps are freed once nothing refers to them
        spark.sparkContext._jvm.System.gc()
        if best is not None and found < best[0]:
            break
        best, marked = (found, bigrams, sums), tried
        table = np.zeros((classes + 2, classes + 2))
        table[: classes + 1, : classes + 1] = bigrams
        if not sums[-1]:
            break
    return marked, Model(best[1], *best[2][:-1].reshape(4, classes), texts)


def score(df: DataFrame, **parameters: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row; parameters as in ``fit``."""
    scored = _scores(*fit(df, **parameters))
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
