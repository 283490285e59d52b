"""SentencePiece segmentations sampled without replacement, and decoding.

A text's lattice is the product of the lattices of its units (a blank, written
as U+2581, and what follows up to the next one), because no piece crosses into
another unit.  A piece's weight is ``-alpha * log(2 + rank)``; a
segmentation's probability is proportional to the exponential of the sum of
its weights.  Characters without a piece become byte pieces, and so does a
U+2581 that the text itself holds, as only a blank is written by that sign: what
is decoded is the text.

Gumbel top-k: every segmentation's log probability is perturbed by its own
Gumbel noise and the k largest are the sample.  The search goes down from the
root by A-star: a partial segmentation's bound is the exact maximum of the
perturbed values below it, as the noise is drawn from the top (the child that
keeps the maximum by its probability, the others by a Gumbel truncated at it).
Only the best k + 1 open nodes can matter, so others are dropped.  Noise has 32
bits and never exceeds 23, so where a path's log mass is more than 23 below
the last of the k + 1 nothing beside it can enter, and the rest of the path is
drawn for all texts of a batch at once.  With kappa the (k + 1)-th largest value, a
segmentation is included with probability 1 - exp(-exp(log p - kappa)), whose
logarithm is the inclusion score.

Noise is seeded by the row's key: equal rows give equal samples wherever they
are run.  A null text counts as empty and, like an empty one, has the one empty
segmentation.  Texts with fewer than k segmentations give them all (score 0).  Extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

BLANK = "▁"
REACH = 23.0
SHORT = 256  # characters of a unit whose weights are multiplied as they are
HEAD = 40  # units of a text that are searched first
WIDE = 1 << 17  # ids from here on stand for a character in byte pieces


@dataclass
class Pieces:
    """Hashes of all pieces by length, weights, and what each id decodes to."""

    hashes: np.ndarray
    beginnings: np.ndarray
    ids: np.ndarray
    weights: np.ndarray
    bytes_first: int
    byte_weight: float
    longest: int
    texts: list[bytes]
    guess: np.ndarray  # by slot, where in the hashes its piece is

    @classmethod
    def load(cls, path: str, alpha: float) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 1 << 16:
            raise ValueError(f"ids are packed into 16 bits, but {path} has {n} pieces")
        names = [model.id_to_piece(i) for i in range(n)]
        weights = np.zeros(n)
        found, texts = [], [b""] * n
        first = next(i for i in range(n) if model.is_byte(i))
        for i, name in enumerate(names):
            if model.is_byte(i):
                texts[i] = bytes([i - first])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts[i] = name.replace(BLANK, " ").encode()
                # pieces of several blanks are no part of merges
                if BLANK not in name[1:]:
                    found.append(i)
        for rank, i in enumerate(found):
            weights[i] = -alpha * math.log(2 + rank)
        unseen = -alpha * math.log(2 + len(found))
        weights[first : first + 256] = unseen
        hashes = np.array([hash_of(names[i]) for i in found], np.uint64)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two pieces have the same hash")
        begun = np.array([hash_of(b) for b in {names[i][:n] for i in found for n in range(1, len(names[i]))}], np.uint64)
        order = np.argsort(hashes)
        guess = np.zeros(1 << 21, np.uint16)
        guess[_slot(hashes[order])] = np.arange(len(order))
        return cls(hashes[order], begun, np.array(found)[order], weights, first, unseen, max(len(names[i]) for i in found), texts, guess)

    def find(self, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Where in the hashes each one would be; one of two pieces that share a slot is looked up."""
        where = self.guess[slot].astype(np.int64)
        missed = np.flatnonzero(self.hashes[where] != h)
        where[missed] = np.minimum(np.searchsorted(self.hashes, h[missed]), len(self.hashes) - 1)
        return where

    def weight_of(self, piece: np.ndarray) -> np.ndarray:
        """Weights of ids, and of characters that stand for several bytes."""
        out = self.weights[np.minimum(piece, len(self.weights) - 1)]
        wide = np.flatnonzero(piece >= WIDE)
        if len(wide):
            code = piece[wide] - WIDE
            out[wide] = self.byte_weight * (2 + (code >= 0x800) + (code >= 0x10000))
        return out


_BASE = np.uint64(0x9E3779B97F4A7C15)


def hash_of(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_BASE) + ord(c) + 1) % 2**64
    return h


def _slot(h: np.ndarray) -> np.ndarray:
    return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 21)


class Lattice:
    """Edges of the lattices of distinct units, which lie end to end."""

    def __init__(self, units: list[str], pieces: Pieces, seen: np.ndarray):
        joined = "".join([BLANK + u for u in units])
        code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        n = len(code)
        # the sign of a blank inside a unit is the text's own: no piece holds what it counts as here
        spelt = code
        inner = code == ord(BLANK)
        inner[self.starts] = False
        if inner.any():
            code = np.where(inner, np.uint64(0x110000), code)
        unit_end = np.repeat(self.ends.astype(np.int32) if n < 2**31 else self.ends, sizes)
        # the piece from each place of each length, in a table whose cells lie in the order of edges
        made = np.zeros((n, pieces.longest), np.int32)
        h = np.zeros(n, np.uint64)
        live = np.arange(n)
        for length in range(1, pieces.longest + 1):
            live = live[live + length <= unit_end[live]]
            if not len(live):
                break
            step = h[live] * _BASE + code[live + length - 1] + np.uint64(1)
            h[live] = step
            slot = _slot(step)
            kind = seen[slot]
            maybe = np.flatnonzero(kind & 1)
            part = step[maybe]
            where = pieces.find(part, slot[maybe])
            real = pieces.hashes[where] == part
            made[live[maybe[real]], length - 1] = pieces.ids[where[real]]
            # only where a longer piece begins like this
            live = live[kind > 1]
        lone = np.flatnonzero(made[:, 0] == 0)
        value = spelt[lone].astype(np.int32)
        made[lone, 0] = np.where(value < 128, pieces.bytes_first + value, WIDE + value)
        cell = np.flatnonzero(made)
        piece = made.ravel()[cell]
        cell = cell.astype(np.int32) if cell[-1] < 2**31 else cell
        begin = cell // cell.dtype.type(pieces.longest)
        finish = cell - begin * cell.dtype.type(pieces.longest - 1) + cell.dtype.type(1)
        del made, h
        weight = pieces.weight_of(piece)
        # backward sums, from each unit's end, all units at once
        distance = unit_end[begin] - begin
        inside = finish < unit_end[begin]
        self.begin, self.finish, self.piece, self.weight = begin, finish, piece, weight
        by = np.argsort(distance.astype(np.int16) if sizes.max() < 2**15 else distance, kind="stable")
        new = np.flatnonzero(np.concatenate(([True], np.diff(begin[by]) != 0)))
        farthest = distance[by[new]]
        bounds = np.searchsorted(farthest, np.arange(1, int(farthest[-1]) + 2))
        places = begin[by[new]]
        spans = [(lo, hi, new[lo], new[hi] if hi < len(new) else len(by)) for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if lo < hi]
        onward, within = finish[by], inside[by]
        del distance, cell
        if sizes.max() <= SHORT:  # no product of weights can underflow
            heavy = np.exp(weight)
            sums = np.ones(n + 1)
            moved = heavy[by]
            for lo, hi, x, y in spans:
                sums[places[lo:hi]] = np.add.reduceat(moved[x:y] * np.where(within[x:y], sums[onward[x:y]], 1.0), new[lo:hi] - x)
            del by, onward, within, moved
            share = heavy
            share *= np.where(inside, sums[finish], 1.0)
            share /= sums[begin]
            self.back = np.log(sums)
        else:
            back = np.zeros(n + 1)
            moved = weight[by]
            for lo, hi, x, y in spans:
                back[places[lo:hi]] = np.logaddexp.reduceat(moved[x:y] + np.where(within[x:y], back[onward[x:y]], 0.0), new[lo:hi] - x)
            del by, onward, within, moved
            share = np.exp(weight + np.where(inside, back[finish], 0.0) - back[begin])
            self.back = back
        self.inside = inside
        self.first = np.concatenate(([0], np.cumsum(np.bincount(self.begin, minlength=n))))
        # in place: a batch's edges are many, and executors hold several workers
        keys = np.cumsum(share, out=share)
        last = self.first[1:] - 1
        if n:
            keys -= np.concatenate(([0.0], keys[last]))[begin]
        np.minimum(keys, 1.0, out=keys)
        keys[last] = 1.0
        keys += begin
        self.keys = keys

    def edge(self, place: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge from each place that a number in [0, 1) falls on; few have more than two to pass."""
        out, aim = self.first[place], place + u
        last = self.first[place + 1] - 1
        left = np.flatnonzero((out < last) & (self.keys[out] <= aim))
        while len(left):
            now = out[left] + 1
            out[left] = now
            left = left[(now < last[left]) & (self.keys[now] <= aim[left])]
        return out

    def listed(self, types: np.ndarray) -> tuple[dict[int, tuple[int, int]], list, tuple]:
        """Some units with places of their own: each unit's span, the real places, and the edges as lists."""
        types = np.unique(types)
        sizes = self.ends[types] - self.starts[types]
        stop = np.cumsum(sizes)
        place = _ranges(self.starts[types], sizes)
        many = self.first[place + 1] - self.first[place]
        edge = _ranges(self.first[place], many)
        back = np.repeat(place - np.arange(len(place)), many)
        spans = dict(zip(types.tolist(), zip((stop - sizes).tolist(), stop.tolist(), strict=True), strict=True))
        fraction = self.keys[edge] - self.begin[edge]
        log_p = self.weight[edge] + np.where(self.inside[edge], self.back[self.finish[edge]], 0.0) - self.back[self.begin[edge]]
        upto = np.concatenate(([0], np.cumsum(many)))
        edges = (upto.tolist(), (self.finish[edge] - back).tolist(), self.piece[edge].tolist(), log_p.tolist(), fraction.tolist())
        return spans, place.tolist(), edges


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, end to end."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) from 64-bit states."""
    x = seed
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Open:
    """A partial segmentation: unit and place reached, log mass, perturbed maximum, pieces so far."""

    __slots__ = ("at", "mass", "path", "top", "unit")

    def __init__(self, unit: int, at: int, mass: float, top: float, path: list):
        self.unit, self.at, self.mass, self.top, self.path = unit, at, mass, top, path


def top_down(lists: tuple, spans: list[tuple[int, int]], whole: bool, k: int, seed: int) -> tuple[list[Open], float] | None:
    """The k best nodes, each searched down to where nothing beside it can enter, and kappa (minus infinity: none left).

    ``lists`` are the edges and ``spans`` the places of the first units of a
    text; None if they do not reach far enough and are not the ``whole``.
    """
    upto, finish, piece, share, fraction = lists
    bits = random.Random(seed).getrandbits
    log, exp = math.log, math.exp
    n = len(spans)
    first = -log(-log((bits(32) + 0.5) * 2.0**-32))
    best = [Open(0, spans[0][0], 0.0, first, [])]
    floor = -math.inf
    for r in range(k):
        if r >= len(best):
            break
        node = best[r]
        unit, at, mass, path, top = node.unit, node.at, node.mass, list(node.path), node.top
        end = spans[unit][1] if unit < n else 0
        while unit < n and mass + REACH > floor:
            a, z = upto[at], upto[at + 1]
            chosen = a
            if z - a > 1:
                u = bits(32) * 2.0**-32
                while u >= fraction[chosen]:
                    chosen += 1
                for c in range(a, z):
                    below = mass + share[c]
                    if c == chosen or below + REACH <= floor:
                        continue
                    u = (bits(32) + 0.5) * 2.0**-32
                    # over the floor only if -log(u) < exp(below - floor), and 1 - u is less than -log(u)
                    if u < 0.95 and floor - below > 3.0:
                        continue
                    # a Gumbel at this mass, given that it is under the maximum
                    value = below - log(exp(below - top) - log(u))
                    if value <= floor:
                        continue
                    past = finish[c] >= end
                    at2 = finish[c] if not past else spans[unit + 1][0] if unit + 1 < n else -1
                    best.append(Open(unit + past, at2, below, value, [*path, piece[c]]))
                    best[r + 1 :] = sorted(best[r + 1 :], key=lambda o: -o.top)[: k - r]
                    if len(best) > k:
                        floor = best[k].top
            mass += share[chosen]
            path.append(piece[chosen])
            at = finish[chosen]
            if at >= end:
                unit += 1
                at, end = spans[unit] if unit < n else (-1, 0)
        if unit >= n and not whole and mass + REACH > floor:
            return None
        best[r] = Open(unit, at, mass, top, path)
    return best[:k], best[k].top if len(best) > k else -math.inf


def drawn(lattice: Lattice, types: np.ndarray, start: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of each unit from its start on (flat), how many each has, and their log probability."""
    n = len(types)
    at, end = start.copy(), lattice.ends[types]
    # inside a unit the conditional probabilities telescope to the pieces' weights over the sum at its start
    count, mass = np.zeros(n, np.int64), np.where(at < end, -lattice.back[at], 0.0)
    live = np.argsort(start, kind="stable")  # equal units side by side, so that lookups stay near each other
    live = live[at[live] < end[live]]
    # what goes on is held in that order, without gaps
    place, stop, seed, log_p = at[live], end[live], state[live], mass[live]
    steps = []
    step = 0
    while len(live):
        edge = lattice.edge(place, _uniform(seed + np.uint64(step * 0xD1B54A32D192ED03 % 2**64)))
        steps.append((live, lattice.piece[edge]))
        log_p += lattice.weight[edge]
        place = lattice.finish[edge]
        step += 1
        on = place < stop
        done = live[~on]
        count[done] = step
        mass[done] = log_p[~on]
        live, place, stop, seed, log_p = live[on], place[on], stop[on], seed[on], log_p[on]
    offset = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), np.int64)
    for k, (who, piece) in enumerate(steps):
        flat[offset[who] + k] = piece
    return flat, count, mass


def spelled(piece: np.ndarray, bytes_first: int) -> np.ndarray:
    """Real ids: characters without a piece become their bytes' pieces."""
    wide = np.flatnonzero(piece >= WIDE)
    if not len(wide):
        return piece
    code = {int(c): [bytes_first + b for b in chr(int(c) - WIDE).encode("utf-8", "replace")] for c in np.unique(piece[wide])}
    many = np.ones(len(piece), np.int64)
    many[wide] = [len(code[int(c)]) for c in piece[wide]]
    out = np.repeat(piece, many)
    for i, at in zip(wide.tolist(), (np.cumsum(many) - many)[wide].tolist(), strict=True):
        out[at : at + many[i]] = code[int(piece[i])]
    return out


@dataclass
class Sample:
    row: int
    nth: int
    ids: np.ndarray
    log_prob: float
    perturbed: float
    log_inclusion: float


def segment(texts: pa.Array, seeds: list[int], pieces: Pieces, seen: np.ndarray, k: int) -> list[Sample]:
    """The k samples of each text, row by row."""
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = np.cumsum(sizes) - sizes
    types = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    lattice = Lattice(coded.dictionary.to_pylist(), pieces, seen)
    picked, kappa = [], []
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    nth = np.arange(len(types)) - offset[row_of]
    head = types[nth < HEAD]
    lists = lattice.listed(head)
    for row, (o, n) in enumerate(zip(offset.tolist(), sizes.tolist(), strict=True)):
        if empty[row]:
            picked.append([])
            kappa.append(-math.inf)
            continue
        reach, (spans, places, edges) = HEAD, lists
        while True:
            own = types[o : o + min(n, reach)].tolist()
            got = top_down(edges, [spans[t] for t in own], reach >= n, k, seeds[row])
            if got:
                break
            reach *= 4
            spans, places, edges = lattice.listed(types[o : o + min(n, reach)])
        for node in got[0]:
            if 0 <= node.unit < len(own) and node.at >= 0:
                node.at = places[node.at]
        picked.append(got[0])
        kappa.append(got[1])
    out = [Sample(row, 0, np.zeros(0, np.int64), 0.0, 0.0, 0.0) for row in np.flatnonzero(empty).tolist()]
    base = np.array([s & (2**64 - 1) for s in seeds], np.uint64)
    for r in range(k):
        rows = [i for i, p in enumerate(picked) if len(p) > r]
        if not rows:
            break
        reached = np.full(len(sizes), np.iinfo(np.int64).max)
        reached[rows] = [picked[i][r].unit for i in rows]
        use = np.flatnonzero(nth >= reached[row_of])
        start = lattice.starts[types[use]]
        part = np.flatnonzero(nth[use] == reached[row_of[use]])
        within = np.array([picked[i][r].at for i in row_of[use[part]].tolist()], np.int64)
        start[part] = np.where(within >= 0, within, start[part])
        state = base[row_of[use]] + np.uint64((r + 1) * 0xA24BAED4963EE407 % 2**64) + nth[use].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
        flat, count, mass = drawn(lattice, types[use], start, state)
        by_row = np.bincount(row_of[use], count, len(sizes)).astype(np.int64)
        ends = np.cumsum(by_row)
        total = np.bincount(row_of[use], mass, len(sizes))
        for i in rows:
            node = picked[i][r]
            ids = np.concatenate([np.array(node.path, np.int64), flat[ends[i] - by_row[i] : ends[i]]])
            log_p = node.mass + float(total[i])
            out.append(Sample(i, r, spelled(ids, pieces.bytes_first), log_p, node.top, _included(log_p - kappa[i])))
    return out


def _included(over: float) -> float:
    """log(1 - exp(-exp(over))), which is ``over`` itself far below 0."""
    return over if over < -30 else math.log(-math.expm1(-math.exp(min(over, 700.0))))


def _seen(pieces: Pieces) -> np.ndarray:
    """By hash: 1 where a piece may be, 2 where a longer piece may begin."""
    seen = np.zeros(1 << 21, np.uint8)
    seen[_slot(pieces.beginnings)] = 2
    seen[_slot(pieces.hashes)] |= 1
    return seen


SAMPLES = "sample int, n_pieces long, log_prob double, perturbed double, log_inclusion double, ids binary"


def sample_segmentations(df: DataFrame, model_path: str, k: int = 2, alpha: float = 0.2, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1_250_000) -> DataFrame:
    """One row per sample: id, sample (from 0, best first), n_pieces, log_prob, perturbed, log_inclusion, ids.

    ``ids`` holds the piece ids as little-endian 16-bit numbers.  The model is
    read by the driver; its tables (bounded by the vocabulary) travel with the
    task.
    """
    pieces = Pieces.load(model_path, alpha)
    seen = _seen(pieces)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", batch_bytes):
            seeds = [xxhash.xxh64_intdigest(str(i), seed) for i in batch.column("id").to_pylist()]
            got = segment(batch.column("text"), seeds, pieces, seen, k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array([s.row for s in got], pa.int64())),
                    pa.array([s.nth for s in got], pa.int32()),
                    pa.array([len(s.ids) for s in got], pa.int64()),
                    pa.array([s.log_prob for s in got], pa.float64()),
                    pa.array([s.perturbed for s in got], pa.float64()),
                    pa.array([s.log_inclusion for s in got], pa.float64()),
                    pa.array([s.ids.astype("<u2").tobytes() for s in got], pa.binary()),
                ],
                names=[id_col, "sample", "n_pieces", "log_prob", "perturbed", "log_inclusion", "ids"],
            )

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, {SAMPLES}")


def joined(ids: bytes, texts: list[bytes]) -> str:
    """The text of packed ids, without the blank that encoding puts first."""
    whole = b"".join([texts[i] for i in np.frombuffer(ids, "<u2").tolist()])
    return whole.decode("utf-8", "replace").removeprefix(" ")


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """The rows with the text that their ids stand for; null for null ids."""
    texts = Pieces.load(model_path, 1.0).texts
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if b is None else joined(b, texts) for b in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, f"{fields}, `{out}` string")
