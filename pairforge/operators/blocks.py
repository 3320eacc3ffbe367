"""Jaccard join by blocks: rows of like size meet in bulk inside tasks.

Where common grams are in most rows, keys of rare grams meet nearly as often as rows
do, and each meeting of a join costs hundreds of times what a comparison in bulk does.
Here rows are cut into cells of like size and of bounded length and weight. Cells whose
sizes can reach the threshold meet in a task of their own; rows travel once a partner,
as two bytes a gram. In a task, 128 parity bits of every pair (whose differing bits never
outnumber the grams in which two sets differ) are compared, then 256 of what is left, then
the sets themselves as bits. Nothing leaves a task but the pairs that reach the threshold.
The work is quadratic in the rows of like size, at a few ns a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells to which a table is cut, rows of a cell at least, and bytes of a cell's sets as bits at most.
CELLS, LEAST_ROWS, CELL_BYTES = 16, 1_000, 64 << 20
#: Rows of either side that meet at once, and pairs whose sets are compared at once.
_ROWS, _COLUMNS, _PAIRS = 16, 4_096, 8_192
_WORDS = 4


def sizes_of(sets: DataFrame) -> list[tuple[int, int]]:
    """(size, rows) in order of size: at most one for each number of grams."""
    return sorted((r["n"], r["count"]) for r in sets.groupBy("n").count().collect())


def pairs_of_like_size(sizes: list[tuple[int, int]], t: float) -> float:
    """How many pairs of rows can reach the threshold by their sizes."""
    n, c = (np.array(x, float) for x in zip(*sizes, strict=True)) if sizes else (np.empty(0),) * 2
    before = np.append(0, np.cumsum(c))
    return float((c * (before[np.searchsorted(n, n / t + 1e-6, "right")] - before[:-1] - c / 2)).sum())


def _cells(sizes: list[tuple[int, int]], grams: int) -> list[tuple[int, int, int]]:
    """(least size, greatest size, parts): each part is a cell; rows of one size may be dealt to several."""
    rows = min(max(LEAST_ROWS, sum(c for _, c in sizes) // CELLS), max(1, CELL_BYTES * 8 // grams))
    out, load = [], 2.0
    for n, c in sizes:
        if load + c / rows > 1:
            out.append((n, n, math.ceil(c / rows)))
            load = c / rows
        else:
            out[-1] = (out[-1][0], n, 1)
            load += c / rows
    return out


def _spread(bands: list[tuple[int, int, int]], partners: list[np.ndarray], role: int):
    """Of each row a copy for each meeting of its cell."""
    low, parts = np.array([b[0] for b in bands]), np.array([b[2] for b in bands])
    first = np.cumsum(parts) - parts
    many = np.array([len(p) for p in partners])
    at, every = np.cumsum(many) - many, np.concatenate(partners) if partners else np.empty(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, sets = batch.column("seq").to_numpy(), batch.column("grams")
            band = np.searchsorted(low, batch.column("n").to_numpy(), "right") - 1
            deal = (seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            cell = first[band] + (deal % parts[band].astype(np.uint64)).astype(np.int64)
            packed = sets.flatten().to_numpy().astype(np.uint16)
            ends = np.append(0, np.cumsum(np.diff(sets.offsets.to_numpy()))).astype(np.int32) * 2
            grams = pa.Array.from_buffers(pa.binary(), len(seq), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
            copies = many[cell]
            row = np.repeat(np.arange(len(seq)), copies)
            meeting = every[np.arange(len(row)) + np.repeat(at[cell] - (np.cumsum(copies) - copies), copies)]
            for k in range(0, len(row), 1 << 16):
                some = row[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(meeting[k : k + (1 << 16)]), pa.array(np.full(len(some), role, np.int32)), pa.array(seq[some]), grams.take(pa.array(some))], names=["meeting", "role", "seq", "grams"])

    return run


class _Side:
    """Rows of one cell in order of size."""

    def __init__(self, seq: np.ndarray, start: np.ndarray, n: np.ndarray, data: np.ndarray, base: int, width: int):
        order = np.argsort(n, kind="stable")
        self.seq, self.n = seq[order], n[order].astype(np.int64)
        start, rows = start[order], len(order)
        self.signs, self.bits = np.zeros((_WORDS, rows), np.uint64), np.empty((rows, width // 64), np.uint64)
        for k in range(0, rows, 512):
            own = self.n[k : k + 512]
            first = np.cumsum(own) - own
            row = np.repeat(np.arange(len(own)), own)
            gram = data[np.arange(len(row)) + np.repeat(start[k : k + 512] - first, own)].astype(np.int64)
            dense = np.zeros((len(own), width), np.uint8)
            dense[row, gram - base] = 1
            self.bits[k : k + 512] = np.packbits(dense, axis=1).view(np.uint64)
            bit = (gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            value = np.uint64(1) << (bit & np.uint64(63))
            for w in range(_WORDS):
                self.signs[w, k : k + 512] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == w, value, np.uint64(0)), first)


def _differing(sizes: np.ndarray, t: float) -> np.ndarray:
    """In how many grams two sets may differ that have so many together."""
    return sizes - 2 * np.ceil(sizes * (t / (1 + t)) - 1e-9).astype(np.int64)


def _reached(a: _Side, b: _Side, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs that reach the threshold; of one side with itself each pair once."""
    most = _differing(np.arange(2 * int(max(a.n[-1], b.n[-1])) + 2), t)
    bound = np.minimum(np.maximum.accumulate(most), 255).astype(np.uint8)  # of a run of rows the largest holds; the limit itself goes up and down by parity
    waiting, held = [], 0

    def compared():
        x, y = (np.concatenate(z) for z in zip(*waiting, strict=True))
        for k in range(0, len(x), _PAIRS):
            p, q = x[k : k + _PAIRS], y[k : k + _PAIRS]
            both = np.bitwise_count(a.bits[p] & b.bits[q]).sum(axis=1, dtype=np.int64)
            good = both / (a.n[p] + b.n[q] - both) >= t
            yield p[good], q[good]

    for k in range(0, len(a.n), _ROWS):
        own = slice(k, min(k + _ROWS, len(a.n)))
        least, greatest = a.n[k], a.n[own.stop - 1]
        low = max(k if same else 0, int(np.searchsorted(b.n, math.ceil(least * t - 1e-9))))
        high = int(np.searchsorted(b.n, math.floor(greatest / t + 1e-6), "right"))
        for c in range(low, high, _COLUMNS):
            there = slice(c, min(c + _COLUMNS, high))
            count = np.bitwise_count(a.signs[0, own, None] ^ b.signs[0, None, there])
            count += np.bitwise_count(a.signs[1, own, None] ^ b.signs[1, None, there])
            x, y = np.divmod(np.flatnonzero(count <= bound[greatest + b.n[there]]), there.stop - c)
            if not len(x):
                continue
            n = count[x, y].astype(np.int64)
            x, y = x + k, y + c
            n += np.bitwise_count(a.signs[2, x] ^ b.signs[2, y]) + np.bitwise_count(a.signs[3, x] ^ b.signs[3, y])
            na, nb = a.n[x], b.n[y]
            good = (n <= most[na + nb]) & (np.minimum(na, nb) >= np.maximum(na, nb) * t - 1e-9)
            if same:
                good &= x < y
            waiting.append((x[good], y[good]))
            held += int(good.sum())
            if held >= 16 * _PAIRS:
                yield from compared()
                waiting, held = [], 0
    if waiting:
        yield from compared()


def _met(t: float, grams: int, earliest: bool):
    """(i, j) of a meeting, i < j; earliest: of each j the least i."""

    def run(table: pa.Table) -> pa.Table:
        role, seq = table.column("role").to_numpy(), table.column("seq").to_numpy()
        packed = table.column("grams").cast(pa.large_binary()).combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset : packed.offset + len(packed) + 1] // 2
        data, n = np.frombuffer(packed.buffers()[2], np.uint16)[: ends[-1]], np.diff(ends)
        base = int(data[ends[0] :].min())
        width = -(-(grams - base) // 64) * 64
        side = lambda on: _Side(seq[on], ends[:-1][on], n[on], data, base, width)
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role == 1)
        same = not len(right) and role[0] == 2
        i = j = np.empty(0, np.int64)
        if len(left) and (same or len(right)):
            a = side(left)
            b = a if same else side(right)
            found = [(a.seq[x], b.seq[y]) for x, y in _reached(a, b, t, same)]
            if found:
                x, y = (np.concatenate(z) for z in zip(*found, strict=True))
                i, j = np.minimum(x, y), np.maximum(x, y)
        if earliest and len(j):
            order = np.lexsort((i, j))
            i, j = i[order], j[order]
            first = np.append(True, j[1:] != j[:-1])
            i, j = i[first], j[first]
        return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64())})

    return run


def matches(a: DataFrame, b: DataFrame | None, t: float, grams: int) -> DataFrame:
    """(i, j): the pairs inside ``a``, or of a row of ``a`` and a later one of ``b`` (the earliest of each ``j`` in each meeting), that reach the threshold.

    Both are written sets (seq, n, grams) without empty ones; grams are ranks under ``grams``, and frequent ones come last. With ``b``, all of ``a`` comes before it.
    """
    plans = [_cells(sizes_of(x), grams) for x in ((a,) if b is None else (a, b))]
    cells = [[(low, high) for low, high, parts in plan for _ in range(parts)] for plan in plans]
    one, two = cells[0], cells[-1]
    like = [(x, y) for x, p in enumerate(one) for y, q in enumerate(two) if p[1] >= q[0] * t - 1e-9 and q[1] >= p[0] * t - 1e-9 and (b is not None or x <= y)]
    if not like:
        return a.selectExpr("seq AS i", "seq AS j").limit(0)
    number = lambda cells_, chosen: [np.array(sorted(chosen[c]), np.int64) for c in range(len(cells_))]
    mine, theirs, self_ = ({c: [] for c in range(max(len(one), len(two)))} for _ in range(3))
    for k, (x, y) in enumerate(like):
        if b is None and x == y:
            self_[x].append(k)
        else:
            mine[x].append(k)
            theirs[y].append(k)
    columns, schema = ["seq", "n", "grams"], "meeting long, role int, seq long, grams binary"
    rows = a.select(*columns).mapInArrow(_spread(plans[0], number(one, mine), 0), schema)
    rows = rows.union((a if b is None else b).select(*columns).mapInArrow(_spread(plans[-1], number(two, theirs), 1), schema))
    if b is None:
        rows = rows.union(a.select(*columns).mapInArrow(_spread(plans[0], number(one, self_), 2), schema))
    return rows.repartition(min(len(like), 10_000), "meeting").groupBy("meeting").applyInArrow(_met(t, grams, b is not None), "i long, j long")
