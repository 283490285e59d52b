"""Removal of repeated byte strings over a sparse suffix array.

A byte goes if a string of ``width`` bytes that covers it also starts earlier,
in a document of smaller id or further up in the same one.  Strings are judged
on the input.

1.  Documents are packed into chunks (one row each, bucketed by chunk so that
    later joins do not shuffle the texts).  Every window of ``width`` bytes is
    represented by its leftmost least k-gram hash, its anchor, so equal
    windows have equal anchors at equal offsets.
2.  Anchor hashes are counted by hash range; those seen once cannot belong to
    a repeated window, and a bit per anchor goes back to each chunk.
3.  For the rest, each chunk sends the bytes around the anchor once per
    different context.  Here the suffixes that start at the anchors, and the
    reversed bytes before them, are ordered by deep-shallow sorting: multikey
    quicksort over 8-byte characters down to ``SHALLOW`` bytes, blind tries for
    the groups that are still tied.  Neighbours' common prefix lengths give
    the classes of equal prefixes of each depth, and a window repeats if an
    earlier one is in its class to the right and to the left of the anchor.
4.  A bit per window goes back to the chunk, which removes the bytes.

A string that every document holds, with what stands around it, is one context
per chunk, so no task receives a row per copy.  A short one that stands among
different words everywhere is a context of its own in each place; those of one
anchor go to one task.

Null texts count as empty, documents under ``width`` bytes stay whole, null
ids come last, rows with equal ids are ordered by chunk and place, an empty
table gives an empty result, extra columns are ignored.  What remains of a
text may begin or end inside a character; as a string, such bytes are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, parallelism, save_bucketed

GRAM = 24
SHALLOW = 32
LAST = 2**63 - 1


def pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


# ---- deep-shallow sorting


def words_of_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes (a multiple of 8 wide) as columns of big-endian 8-byte characters."""
    return rows.view(">u8").astype(np.uint64)


def multikey(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first ``depth`` characters, and which sorted rows begin a new group.

    Character by character; only rows that are tied so far are sorted again.
    """
    order = np.arange(len(words))
    new = np.zeros(len(words), bool)
    if len(words):
        new[0] = True
    for c in range(depth):
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(np.bincount(group)[group] > 1) if len(words) else order
        if not len(tied):
            break
        key = words[order[tied], c]
        inner = np.lexsort((key, group[tied]))
        order[tied] = order[tied[inner]]
        key = key[inner]
        changed = np.flatnonzero(key[1:] != key[:-1]) + 1
        new[tied[changed]] = True
    return order, new


class BlindTrie:
    """Orders strings of one length that share a long prefix.

    A node has the depth where its strings part and a child for each byte
    there; a string is led to some leaf by those bytes alone, compared with
    that leaf once, and inserted at the depth where the two part.
    """

    def __init__(self, first: bytes, label: int):
        self.root: list | tuple = (first, [label])

    def insert(self, text: bytes, label: int) -> None:
        node = self.root
        while isinstance(node, list):
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        leaf = node[0]
        if leaf == text:
            node[1].append(label)
            return
        parted = int.from_bytes(leaf) ^ int.from_bytes(text)
        depth = len(text) - (parted.bit_length() + 7) // 8
        above, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][text[depth]] = (text, [label])
            return
        split = [depth, {leaf[depth]: node, text[depth]: (text, [label])}]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def labels(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                out.extend(node[1])
            else:
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of distinct or equal byte rows, and each sorted row's common prefix with the one before."""
    words = words_of_rows(rows)
    order, new = multikey(words, min(SHALLOW // 8, words.shape[1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(order)))
    pairs = starts[sizes == 2]
    if len(pairs):
        a, b = words[order[pairs]], words[order[pairs + 1]]
        parted = (a != b).argmax(axis=1)
        at = np.arange(len(pairs))
        swap = pairs[a[at, parted] > b[at, parted]]
        order[swap], order[swap + 1] = order[swap + 1], order[swap].copy()
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        members = order[s : s + n].tolist()
        trie = BlindTrie(rows[members[0]].tobytes(), members[0])
        for m in members[1:]:
            trie.insert(rows[m].tobytes(), m)
        order[s : s + n] = trie.labels()
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        parted = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(parted.any(axis=1), parted.argmax(axis=1), rows.shape[1])
    return order, common


def prefix_classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each row, a number that equal prefixes of that depth share."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth) if depth else 0
    return out


# ---- anchors


def _rolled(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each position (the last GRAM - 1 positions have none)."""
    base = 0x9E3779B97F4A7C15
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    held = {}
    while step < 16:
        factor = np.uint64(pow(base, step, 2**64))
        h = h[:-step] * factor + h[step:]
        step *= 2
        held[step] = h
    h = held[16][: len(held[16]) - 8] * np.uint64(pow(base, 8, 2**64)) + held[8][16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


class Chunk:
    """The texts of one row of the chunk table, end to end, with their anchors."""

    def __init__(self, lengths: np.ndarray, data: bytes, width: int):
        self.lengths, self.width = lengths, width
        self.raw = data
        self.data = np.frombuffer(data, np.uint8)
        self.starts = np.cumsum(lengths) - lengths

    def anchor(self) -> None:
        """``at`` (position), ``first`` and ``last`` (window starts it stands for)."""
        none = np.zeros(0, np.int64)
        self.at = self.first = self.last = none
        self.hash = np.zeros(0, np.uint64)
        span = self.width - GRAM + 1
        if len(self.data) < self.width:
            return
        h = _rolled(self.data)
        self.all_hashes = h
        low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        # low[s] belongs to the window from s; only windows inside one document count
        windows = np.maximum(self.lengths - self.width + 1, 0)
        begin = np.repeat(self.starts, windows)
        s = begin + np.arange(len(begin)) - np.repeat(np.cumsum(windows) - windows, windows)
        if not len(s):
            return
        at = (low[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        change = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.at, self.first = at[change], s[change]
        self.last = s[np.append(change[1:], len(s)) - 1]
        self.hash = h[self.at]
        del self.all_hashes

    def distinct_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct anchor hashes and whether each occurs more than once here."""
        found, counts = np.unique(self.hash, return_counts=True)
        return found, counts > 1

    def contexts(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors in ``keep``: those first with their context, and the others.

        A context is the bytes that the anchor's windows cover, with its place among them.
        """
        index = np.flatnonzero(keep)
        seen: dict[tuple[int, bytes], int] = {}
        firsts, copies = [], []
        a, f, e = (x[index].tolist() for x in (self.at, self.first, self.last + self.width))
        raw = self.raw
        for i, at, begin, end in zip(index.tolist(), a, f, e, strict=True):
            key = (at - begin, raw[begin:end])
            if key in seen:
                copies.append(i)
            else:
                seen[key] = i
                firsts.append(i)
        return np.array(firsts, np.int64), np.array(copies, np.int64)


def parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def repeated_windows(order_key: list[np.ndarray], before: np.ndarray, low: np.ndarray, right: np.ndarray, left: np.ndarray, width: int) -> np.ndarray:
    """Which windows of each context also start earlier; a row of flags by offset.

    ``before`` and ``low`` are the greatest and least offset of the anchor in
    its windows; ``right`` holds the bytes from the anchor on, ``left`` those
    before it, backwards, both padded with zeros.
    """
    span = width - GRAM + 1
    flags = np.zeros((len(before), span), bool)
    if not len(before):
        return flags
    turn = np.lexsort(order_key[::-1])
    before, low, right, left = before[turn], low[turn], right[turn], left[turn]
    r_order, r_common = deep_shallow(right)
    # alone with its k-gram: nothing to be equal to
    gram = prefix_classes(r_order, r_common, GRAM)
    some = np.flatnonzero(np.bincount(gram)[gram] > 1)
    l_order, l_common = deep_shallow(left[some])
    lowest, greatest = low[some], before[some]
    for offset in range(span):
        active = np.flatnonzero((lowest <= offset) & (offset <= greatest))
        if len(active) < 2:
            continue
        r = prefix_classes(r_order, r_common, width - offset)[some[active]]
        l = prefix_classes(l_order, l_common, offset)[active]  # noqa: E741
        key = r * (len(some) + 1) + l
        by = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[by][1:] == key[by][:-1]) + 1
        flags[turn[some[active[by[again]]]], offset] = True
    return flags


# ---- the operator

CHUNKS = "chunk long, ids array<bigint>, lengths binary, data binary, bytes long, rest array<{}>"


def chunked(df: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of whole documents; ``rest`` carries other columns along."""
    kind = df.schema["rest"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes, dict]] = []
        size = 0
        rest_type = None

        def flush() -> pa.RecordBatch:
            nonlocal made
            held.sort(key=lambda x: LAST if x[0] is None else x[0])
            row = pa.RecordBatch.from_pylist(
                [
                    {
                        "chunk": task << 20 | made,
                        "ids": [i for i, _, _ in held],
                        "lengths": np.array([len(t) for _, t, _ in held], np.int64).tobytes(),
                        "data": pack(b"".join(t for _, t, _ in held)),
                        "bytes": size,
                        "rest": [r for _, _, r in held],
                    }
                ],
                schema=pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("data", pa.binary()), ("bytes", pa.int64()), ("rest", pa.list_(rest_type))]),
            )
            made += 1
            held.clear()
            return row

        for batch in batches:
            rest_type = batch.schema.field("rest").type
            for i, text, rest in zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("rest").to_pylist(), strict=True):
                raw = text.as_py() or b""
                held.append((i, raw, rest))
                size += len(raw)
                if size >= chunk_bytes or len(held) >= 20_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return df.mapInArrow(run, CHUNKS.format(kind))


def _load(batch: pa.RecordBatch, width: int) -> Iterator[tuple[dict, Chunk]]:
    for i in range(batch.num_rows):
        row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "rest"}
        chunk = Chunk(np.frombuffer(row["lengths"], np.int64), unpack(row.pop("data")), width)
        chunk.anchor()
        yield row, chunk
    give_back()


def _kept(row: dict, chunk: Chunk) -> np.ndarray:
    """The anchors whose hash occurs elsewhere too, by the bits that came back."""
    found, _ = chunk.distinct_hashes()
    part = parts_of(found, row["parts"])
    keep = np.zeros(len(found), bool)
    for m in row["marks"] or []:
        own = np.flatnonzero(part == m["part"])
        keep[own] = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=len(own)).astype(bool)
    return keep[np.searchsorted(found, chunk.hash)] if len(found) else np.zeros(0, bool)


def _ask(chunks: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, chunk, hashes, more): distinct anchor hashes of each chunk by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in _load(batch, width):
                found, more = chunk.distinct_hashes()
                part = parts_of(found, parts)
                used = np.unique(part)
                if len(used):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(used, pa.int32()),
                            "chunk": pa.array([row["chunk"]] * len(used), pa.int64()),
                            "hashes": pa.array([found[part == p].tobytes() for p in used], pa.binary()),
                            "more": pa.array([np.packbits(more[part == p]).tobytes() for p in used], pa.binary()),
                        }
                    )

    return chunks.mapInArrow(run, "part int, chunk long, hashes binary, more binary")


def _answer(table: pa.Table) -> pa.Table:
    hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
    more = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)) for x, h in zip(table.column("more").to_pylist(), hashes, strict=True)]
    found, where, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    twice = counts > 1
    twice[where[np.concatenate(more).astype(bool)]] = True
    ends = np.cumsum([len(h) for h in hashes])
    bits = [np.packbits(twice[where[e - len(h) : e]]).tobytes() for h, e in zip(hashes, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})


def _marked(chunks: DataFrame, marks: DataFrame, name: str) -> DataFrame:
    gathered = marks.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name))
    return chunks.join(gathered, "chunk", "left")


SENT = "part int, chunk long, n int, head binary, body binary"


def _send(marked: DataFrame, width: int) -> DataFrame:
    """(part, chunk, contexts): each chunk's different contexts of anchors that occur elsewhere too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, chunk in _load(batch, width):
                first, _ = chunk.contexts(_kept(row, chunk))
                if not len(first):
                    continue
                part = parts_of(chunk.hash[first], row["parts"])
                doc = np.searchsorted(chunk.starts + chunk.lengths, chunk.first[first], side="right")
                ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
                rows = []
                for p in np.unique(part):
                    own = np.flatnonzero(part == p)
                    f = first[own]
                    head = np.stack([ids[doc[own]], doc[own], chunk.at[f], chunk.at[f] - chunk.first[f], chunk.at[f] - chunk.last[f]])
                    body = b"".join(chunk.raw[a:b] for a, b in zip(chunk.first[f].tolist(), (chunk.last[f] + width).tolist(), strict=True))
                    rows.append({"part": int(p), "chunk": row["chunk"], "n": len(own), "head": pack(head.tobytes()), "body": pack(body)})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("head", pa.binary()), ("body", pa.binary())]))

    return marked.mapInArrow(run, SENT)


def _judge(width: int):
    before_bytes = -(-(width - GRAM) // 8) * 8
    after_bytes = -(-width // 8) * 8

    def judge(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        chunks = np.repeat(table.column("chunk").to_numpy(), sizes)
        heads = [np.frombuffer(unpack(x), np.int64).reshape(5, -1) for x in table.column("head").to_pylist()]
        ids, doc, at, before, low = np.concatenate(heads, axis=1)
        body = np.frombuffer(b"".join(unpack(x) for x in table.column("body").to_pylist()) + bytes(after_bytes), np.uint8)
        lengths = before - low + width
        anchor = np.cumsum(lengths) - lengths + before
        order_key = [ids, chunks, doc, at]
        flags = np.zeros((len(ids), width - GRAM + 1), bool)
        offsets = np.arange(width - GRAM + 1)
        # equal contexts: all but the earliest repeat in full
        right = _cut(body, anchor, width - low, after_bytes)
        left = _cut(body, anchor - 1, before, before_bytes, -1)
        turn = np.lexsort(order_key[::-1])
        mixed = _row_hash(right, left, before, low)
        _, leader = np.unique(mixed[turn], return_index=True)
        where = np.searchsorted(mixed[turn][leader], mixed)
        leads = turn[leader][where]
        same = (leads != np.arange(len(ids))) & (right == right[leads]).all(axis=1) & (left == left[leads]).all(axis=1) & (before == before[leads]) & (low == low[leads])
        flags[same] = (offsets >= low[same, None]) & (offsets <= before[same, None])
        rest = np.flatnonzero(~same)
        flags[rest] = repeated_windows([k[rest] for k in order_key], before[rest], low[rest], right[rest], left[rest], width)
        packed = np.packbits(flags, axis=1)
        ends = np.cumsum(sizes)
        bits = [pack(packed[e - n : e].tobytes()) for e, n in zip(ends, sizes, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "bits": pa.array(bits, pa.binary())})

    return judge


def _cut(body: np.ndarray, at: np.ndarray, lengths: np.ndarray, wide: int, step: int = 1) -> np.ndarray:
    """Rows of bytes from each position on, forwards or backwards, zeros beyond their length."""
    rows = np.empty((len(at), wide), np.uint8)
    for i in range(wide):
        rows[:, i] = np.where(lengths > i, body[np.clip(at + step * i, 0, len(body) - 1)], 0)
    return rows


def _row_hash(right: np.ndarray, left: np.ndarray, before: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = (before * 256 + low).astype(np.uint64)
    for words in (words_of_rows(right), words_of_rows(left)):
        for c in range(words.shape[1]):
            h = (h ^ words[:, c]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


REMOVED = "doc_id long, kept {}, n_bytes long, n_removed long, n_spans long, rest {}"


def _remove(marked: DataFrame, width: int, as_text: bool) -> DataFrame:
    kind = marked.schema["rest"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, (row, chunk) in enumerate(_load(batch, width)):
                delta = np.zeros(len(chunk.data) + 1, np.int64)
                first, copies = chunk.contexts(_kept(row, chunk))
                np.add.at(delta, chunk.first[copies], 1)
                np.add.at(delta, chunk.last[copies] + width, -1)
                if len(first):
                    part = parts_of(chunk.hash[first], row["parts"])
                    for m in row["windows"] or []:
                        own = first[part == m["part"]]
                        packed = np.frombuffer(unpack(m["bits"]), np.uint8).reshape(len(own), -1)
                        which, offset = np.nonzero(np.unpackbits(packed, axis=1, count=width - GRAM + 1))
                        start = chunk.at[own[which]] - offset
                        np.add.at(delta, start, 1)
                        np.add.at(delta, start + width, -1)
                gone = np.cumsum(delta[:-1]) > 0
                edge = gone.copy()
                edge[1:] &= ~gone[:-1]
                edge[chunk.starts[chunk.lengths > 0]] |= gone[chunk.starts[chunk.lengths > 0]]
                removed, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, edge))
                a, b = chunk.starts, chunk.starts + chunk.lengths
                kept = [chunk.data[s:e][~gone[s:e]].tobytes() if n else chunk.raw[s:e] for s, e, n in zip(a.tolist(), b.tolist(), (removed[b] - removed[a]).tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["ids"], pa.int64()),
                        "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()),
                        "n_bytes": pa.array(chunk.lengths),
                        "n_removed": pa.array(removed[b] - removed[a]),
                        "n_spans": pa.array(spans[b] - spans[a]),
                        "rest": batch.column("rest")[at].values,
                    }
                )

    return marked.mapInArrow(run, REMOVED.format("string" if as_text else "binary", kind))


def remove_repeats(df: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 2_000_000, part_bytes: int = 24_000_000, carried: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, kept (the remaining bytes, or a string of their whole characters), n_bytes, n_removed and n_spans of every row, and the ``carried`` columns."""
    spark = df.sparkSession
    scratch = Scratch(spark, "suffix")
    buckets = parallelism(spark)
    rest = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in carried])
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"), rest.alias("rest"))
    chunks = save_bucketed(scratch, chunked(docs, chunk_bytes), "chunks", "chunk", "none")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    parts = max(buckets, -(-total // part_bytes))
    chunks = chunks.withColumn("parts", F.lit(parts))
    plain = chunks.drop("rest", "ids")
    asked = _ask(plain, parts, width)
    marks = scratch.save(asked.groupBy("part").applyInArrow(_answer, "chunk long, part int, bits binary"), "marks")
    sent = _send(_marked(chunks.drop("rest"), marks, "marks"), width)
    windows = scratch.save(sent.groupBy("part").applyInArrow(_judge(width), "chunk long, part int, bits binary"), "windows")
    removed = _remove(_marked(_marked(chunks, marks, "marks"), windows, "windows"), width, as_text)
    return removed.select("doc_id", "kept", "n_bytes", "n_removed", "n_spans", *[F.col(f"rest.{c}") for c in carried])


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], width: int = 100) -> dict[int, tuple[int, int, str]]:
    """What the operator must find, by a table of all strings: for tests."""
    seen, out = set(), {}
    for i, raw in sorted(texts):
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        spans = sum(1 for p in range(len(raw)) if gone[p] and (not p or not gone[p - 1]))
        out[i] = (sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out
