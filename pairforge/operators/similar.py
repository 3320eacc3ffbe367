"""Near duplicates by Jaccard of trigram sets: the join and the greedy rule over it.

Normalised texts have 38 characters, so there are at most ``_GRAMS`` grams in any
corpus: their frequencies are a table of bounded size, and a row's grams are kept
as ranks from the rarest on. Rows that reach the threshold share a gram (or, where
that leaves too many candidates, two grams) of their rarest. Candidates pass a
filter of sizes, one of positions, and one of 256 parity bits, whose differing
bits never outnumber the grams in which two sets differ; then sets are compared.

Where such keys meet too often, rows of like size meet in blocks instead (``blocks``).

The greedy rule needs the kept rows only. Rows are taken in ranges of their order:
a range's own candidates are joined and settled, then all later rows are joined
with the rows it kept, and those that resemble one leave. A range is as long as its
candidates stay within a bound, so a family of any size never meets itself pair by
pair: its first members settle, and the rest leave by the one that was kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.indexing import dense_index, sized, written
from pairforge.operators import blocks

_CHARS = " 0123456789_abcdefghijklmnopqrstuvwxyz"
_W = len(_CHARS)
#: Trigrams, then single characters and pairs, which stand for texts of that length.
_GRAMS = _W**3 + _W + _W**2
_CODE = np.zeros(256, np.int64)
_CODE[np.frombuffer(_CHARS.encode(), np.uint8)] = np.arange(_W)
#: Candidates of a range (keys that meet, most of which the filters stop): so many, or so many for each row that is left.
RANGE_PAIRS, ROW_PAIRS = 3_000_000, 200
#: Pairs that blocks compare in the time that one meeting of a join takes.
PAIRS_A_MEETING = 100
#: Rows of one key that meet in one task; keys with more are split.
BLOCK_ROWS = 5_000
#: Stretches of order that a range is cut from.
_STRETCHES = 256
#: Edges (16 bytes each) that one task settles; more are settled in rounds.
TASK_EDGES = 500_000
_SLICE = 4 << 20
_SIGNS = [f"s{i}" for i in range(4)]
#: Odd numbers of the hashes whose least values over a set make its sketch.
_SKETCH = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _grams(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of all rows' distinct grams, in order of rows."""
    raw = keys.cast(pa.large_binary())
    n = len(raw)
    _, offs, buffer = raw.buffers()
    offsets = np.frombuffer(offs, np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None and buffer.size else np.empty(0, np.uint8)
    at, size = offsets - offsets[0], np.diff(offsets)
    many = np.where(size >= 3, size - 2, np.minimum(size, 1))
    row = np.repeat(np.arange(n), many)
    place = np.arange(len(row)) + np.repeat(at[:-1] - (np.cumsum(many) - many), many)
    c = np.append(_CODE[data], [0, 0])
    gram = (c[place] * _W + c[place + 1]) * _W + c[place + 2]
    short = np.flatnonzero(size[row] < 3)
    gram[short] = _W**3 + np.where(size[row[short]] == 1, c[place[short]], _W + c[place[short]] * _W + c[place[short] + 1])
    pair = np.unique(row * _GRAMS + gram)
    return pair // _GRAMS, pair % _GRAMS


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``_SLICE`` bytes of keys."""
    for batch in batches:
        if batch.num_rows:
            run = np.cumsum(pc.binary_length(batch.column("key")).to_numpy())
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(run, (run[first - 1] if first else 0) + _SLICE, "right")))
                yield batch.slice(first, last - first)
                first = last


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_GRAMS, np.int64)
    for batch in _sliced(batches):
        total += np.bincount(_grams(batch.column("key"))[1], minlength=_GRAMS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["gram", "n"])


def _ranked(rank: np.ndarray):
    """Of each row its grams as ranks from the rarest on, their number, the parity of their bits, and a sketch that near copies often share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            row, gram = _grams(batch.column("key"))
            pair = np.sort(row * _GRAMS + rank[gram])
            grams, n = (pair % _GRAMS).astype(np.int32), np.bincount(row, minlength=batch.num_rows)
            bit = (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
            value, full = np.uint64(1) << (bit & np.uint64(63)), np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[full]
            signs = []
            for i in range(len(_SIGNS)):
                sign = np.zeros(batch.num_rows, np.uint64)
                if len(full):
                    sign[full] = np.bitwise_xor.reduceat(np.where(bit >> np.uint64(6) == i, value, np.uint64(0)), starts)
                signs.append(pa.array(sign.view(np.int64)))
            sketch = np.zeros(batch.num_rows, np.uint64)
            for odd in _SKETCH if len(full) else ():
                mixed = (grams.astype(np.uint64) + np.uint64(1)) * np.uint64(odd)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(_SKETCH[0])
                sketch[full] = sketch[full] * np.uint64(_SKETCH[1]) + np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), starts)
            sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(n.astype(np.int32)), sets, pa.array(sketch.view(np.int64)), *signs], names=["seq", "n", "grams", "sketch", *_SIGNS])

    return run


def ranked_sets(rows: DataFrame) -> DataFrame:
    """(seq, n, grams, sketch, signature) of rows (seq, key) with normalised keys, written."""
    df = np.zeros(_GRAMS, np.int64)
    for r in rows.select("key").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # _GRAMS rows at most
        df[r["gram"]] = r["n"]
    rank = np.empty(_GRAMS, np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(_GRAMS)
    return written(rows.select("seq", "key").mapInArrow(_ranked(rank), "seq long, n int, grams array<int>, sketch long, " + ", ".join(f"{s} long" for s in _SIGNS)), "sets")


def _prefix(t: float, shared: int) -> Column:
    """How many of its rarest grams a row has to show, for two rows that reach the threshold to share so many of them."""
    return F.least(F.col("n"), (F.col("n") - F.ceil(F.col("n") * t - 1e-9) + shared).cast("int"))


def tokens(sets: DataFrame, t: float, shared: int) -> DataFrame:
    """A row for each key of each set: one rare gram, or two."""
    own = ["seq", "n", *_SIGNS]
    one = sets.where("n > 0").select(*own, "grams", F.posexplode(F.slice("grams", F.lit(1), _prefix(t, shared))).alias("pos", "gram"))
    if shared == 1:
        return one.select(*own, "pos", F.col("gram").cast("long").alias("key"))
    rest = F.slice("grams", F.col("pos") + 2, F.greatest(F.lit(0), _prefix(t, 2) - F.col("pos") - 1))
    two = one.select(*own, "pos", "gram", F.explode(rest).alias("other")).select(*own, "pos", (F.col("gram").cast("long") * 65536 + F.col("other")).alias("key"))
    # sets so small that one common gram can be enough
    few = one.where(F.col("n") <= 1 / t**2 + 1e-9).select(*own, "pos", (-1 - F.col("gram").cast("long")).alias("key"))
    return two.union(few)


def shared_grams(sets: DataFrame, t: float) -> tuple[int, float]:
    """1, or 2 where keys of two grams cost less: they are more than single ones, but meet far less often. And how often single ones meet at most."""
    one = sets.where("n > 0").select(_prefix(t, 1).alias("p"), F.explode(F.slice("grams", F.lit(1), _prefix(t, 1))).alias("gram"))
    meetings = one.groupBy("gram").agg(F.count("*").alias("c")).agg(F.sum(F.col("c").cast("double") * F.col("c") / 2)).first()[0] or 0
    p = _prefix(t, 2).cast("double")
    rows = sets.agg(F.sum(p * (p - 1) / 2)).first()[0] or 0
    return (2 if meetings > 40 * rows else 1), meetings


def matches(a: DataFrame, b: DataFrame, sets: DataFrame, t: float, big: bool) -> DataFrame:
    """(i, j): pairs of ``a`` before ``b``, both tokens, whose ``sets`` reach the threshold. big: whether keys may be hot."""
    if big:
        hot = written(b.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK_ROWS).select("key", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks")), "hot")
        hot = sized(hot, 16)
        b = b.join(hot, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
        a = a.join(hot, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    x, y = a.alias("a"), b.alias("b")
    sizes = F.col("a.n") + F.col("b.n")
    need = F.ceil(sizes * (t / (1 + t)) - 1e-9)
    differing = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in _SIGNS), F.lit(0))
    reach = F.least("a.pos", "b.pos") + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.seq") < F.col("b.seq")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * t - 1e-9) & (reach >= need) & (differing <= sizes - 2 * need)
    if big:
        on = on & (F.col("a.block") == F.col("b.block"))
    found = x.join(y, on).select(F.col("a.seq").alias("i"), F.col("b.seq").alias("j")).distinct()
    left, right = (sets.select(F.col("seq").alias(k), F.col("grams").alias(f"g{k}")) for k in ("i", "j"))
    both = F.size(F.array_intersect("gi", "gj"))
    return found.join(left, "i").join(right, "j").where(both / (F.size("gi") + F.size("gj") - both) >= t).select("i", "j")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greedy rule over few edges, row by row."""
    parts = [(b.column("i").to_numpy(), b.column("j").to_numpy()) for b in batches]
    i, j = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
    by: dict[int, int] = {}  # duplicates and the earliest kept row of each
    order = np.lexsort((i, j))
    for a, b in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if b not in by and a not in by:
            by[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array(list(by.values()), pa.int64())], names=["j", "i"])


def duplicates_of(edges: DataFrame) -> DataFrame:
    """(id): the duplicates by the greedy rule over written edges (i, j), in rounds over the edges that are open.

    Rows to which no open edge leads are kept, and what they lead to is a duplicate; edges at either are closed.
    """
    gone = edges.select(F.col("j").alias("id")).limit(0)
    at = lambda ids, end: ids.withColumnRenamed("id", end)
    while edges.head(1):
        roots = written(edges.select(F.col("i").alias("id")).distinct().join(edges.select(F.col("j").alias("id")), "id", "left_anti"), "roots")
        hit = written(edges.join(at(roots, "i"), "i", "left_semi").select(F.col("j").alias("id")).distinct(), "hit")
        gone = gone.union(hit)
        edges = written(edges.join(at(roots, "i"), "i", "left_anti").join(at(hit, "i"), "i", "left_anti").join(at(hit, "j"), "j", "left_anti"), "open")
    return gone


def settled(edges: DataFrame) -> DataFrame:
    """(j, i) of the rows that are duplicates by the greedy rule, with the earliest kept row they are linked to; edges (i, j) of places, i < j."""
    edges = written(edges, "edges")
    if edges.count() <= TASK_EDGES:
        return edges.coalesce(1).mapInArrow(_in_order, "j long, i long")
    gone = written(duplicates_of(edges), "gone")
    return edges.join(gone.withColumnRenamed("id", "j"), "j", "left_semi").join(gone.withColumnRenamed("id", "i"), "i", "left_anti").groupBy("j").agg(F.min("i").alias("i"))


def _range_end(keyed: DataFrame, first: int, last: int, room: float) -> int:
    """The last place of a range from ``first`` on whose candidates stay within ``room``; a range is never empty."""
    while True:
        width = max(1, -(-(last - first + 1) // _STRETCHES))
        stretch = F.floor((F.col("seq") - first) / width)
        counts = keyed.where(F.col("seq").between(first, last)).groupBy("key", stretch.alias("b")).agg(F.count("*").cast("double").alias("c"))
        ends = F.sort_array(F.collect_list(F.struct("b", "c")))  # a key has at most _STRETCHES of them
        # candidates that each stretch adds: with the rows of its key before it, and inside
        added = F.aggregate(
            ends,
            F.struct(F.lit(0.0).alias("run"), F.array().cast("array<struct<b:bigint,p:double>>").alias("out")),
            lambda s, x: F.struct((s["run"] + x["c"]).alias("run"), F.concat(s["out"], F.array(F.struct(x["b"].alias("b"), (x["c"] * (s["run"] + x["c"] / 2)).alias("p")))).alias("out")),
            lambda s: s["out"],
        )
        per = counts.groupBy("key").agg(added.alias("added")).select(F.inline("added")).groupBy("b").agg(F.sum("p").alias("p")).orderBy("b").collect()
        run, end = 0.0, None
        for r in per:  # _STRETCHES rows
            run += r["p"]
            if run > room:
                break
            end = first + (r["b"] + 1) * width - 1
        else:
            return last
        if end is not None:
            return min(end, last)
        stop = first + (r["b"] + 1) * width - 1  # the first stretch with candidates has too many
        if width == 1:
            return stop
        first_of = first + r["b"] * width
        return _range_end(keyed, first_of, min(stop, last), room)


def _in_blocks(sets: DataFrame, t: float, meetings: float) -> bool:
    """Whether all pairs of like size cost less than the meetings of keys."""
    return blocks.pairs_of_like_size(blocks.sizes_of(sets), t) <= PAIRS_A_MEETING * meetings


def _block_end(rest: DataFrame, n: int, first: int, last: int, width: int) -> int:
    """The last place of a range of about ``width`` rows, fewer where sketches tell of more than ``RANGE_PAIRS`` near pairs."""
    end = last if n <= width else min(last, first - 1 - (first - last - 1) * width // n)
    own = rest.where(F.col("seq") <= end).select(F.col("sketch").alias("key"), "seq")
    near = own.groupBy("key").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c") / 2)).first()[0] or 0
    return end if near <= RANGE_PAIRS else _range_end(own, first, end, RANGE_PAIRS)


def near_duplicates(rows: DataFrame, t: float) -> DataFrame:
    """(j, i): of rows (seq, key), which are near duplicates of an earlier kept row, and the earliest such."""
    sets = ranked_sets(rows.where("key <> ''"))
    shared, meetings = shared_grams(sets, t)
    bulk = _in_blocks(sets, t, meetings)
    rest, found, room, width = sets, None, 0, max(1, int(RANGE_PAIRS**0.5))
    while True:
        n, first, last = rest.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if not n:
            break
        keyed = tokens(rest, t, shared)
        room = room or max(RANGE_PAIRS, ROW_PAIRS * n)
        if bulk:
            end, width = _block_end(rest, n, first, last, width), width * 4  # what a range keeps thins out the next
        else:
            end = last if meetings <= room else _range_end(keyed.select("key", "seq"), first, last, room)
        here, later = F.col("seq") <= end, F.col("seq") > end
        inside = blocks.matches(rest.where(here), None, t, _GRAMS) if bulk else matches(keyed.where(here), keyed.where(here), rest, t, n > 200 * BLOCK_ROWS)
        own = written(settled(inside), "settled")
        found = own if found is None else found.union(own)
        if end >= last:
            break
        leaders = rest.where(here).join(own.select(F.col("j").alias("seq")), "seq", "left_anti")
        if bulk:
            hit = blocks.matches(written(leaders, "leaders"), rest.where(later), t, _GRAMS)
        else:
            hit = matches(tokens(leaders, t, shared), keyed.where(later), rest, t, n > 200 * BLOCK_ROWS)
        hit = written(hit.groupBy("j").agg(F.min("i").alias("i")).select("j", "i"), "left")
        found = found.union(hit)
        rest = written(rest.where(later).join(hit.select(F.col("j").alias("seq")), "seq", "left_anti"), "rest")
    none = rows.where("key = ''")
    least = none.agg(F.min("seq").alias("i"))
    empty = none.join(F.broadcast(least), F.col("seq") > F.col("i")).select(F.col("seq").alias("j"), "i")  # empty texts equal the first of them; one row is broadcast
    return empty if found is None else found.union(empty)


def near_edges(rows: DataFrame, t: float) -> DataFrame:
    """(i, j): all pairs of rows (seq, key) that reach the threshold; empty keys are linked to the first of them."""
    sets = ranked_sets(rows.where("key <> ''"))
    shared, meetings = shared_grams(sets, t)
    if _in_blocks(sets, t, meetings):
        found = blocks.matches(sets, None, t, _GRAMS)
    else:
        keyed = tokens(sets, t, shared)
        found = matches(keyed, keyed, sets, t, True)
    none = rows.where("key = ''")
    least = none.agg(F.min("seq").alias("i"))
    return found.union(none.join(F.broadcast(least), F.col("seq") > F.col("i")).select("i", F.col("seq").alias("j")))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (ord, …) with seq, their place in order."""
    return written(dense_index(rows, ["ord"], "seq"), "numbered")
