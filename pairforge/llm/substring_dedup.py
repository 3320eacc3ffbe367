"""Removal of word windows that already start in an earlier document (super-k-mer partitioning).

Each document is cut into windows of ``window`` consecutive words. The minimiser
of a window is its smallest hashed m-gram; consecutive windows with the same
minimiser form a super-k-mer and travel as one packed string to the minimiser's
bucket, so a window of 13 words costs about three words of shuffle instead of 13.
Of equal super-k-mers of a slice only those of the smallest doc_id travel; the
others are known to repeat and leave as word ranges, so that a passage held by a
third of the corpus reaches its bucket once a slice.
The number of buckets grows with the text. Spark deals them to the partitions
and sorts each partition by bucket; a bucket's windows are then sorted by hash,
and members of a run of equal hashes are compared byte by byte with the run's
first, so the result is exact. The windows of a bucket that holds more than
``limit`` (a frequent minimiser) leave as plain rows, spread over all tasks by
their words; an aggregate and a join find the smallest doc_id of each.

Defined cases: null or empty text has no words. Rows without a doc_id keep all
words and remove none from others. Rows that repeat a doc_id never remove each
other's words. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import partitions, table, written

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Packed bytes that are unpacked at a time.
_UNPACK = 700_000
_RANGE = [("doc_id", np.int64), ("tag", np.int32), ("begin", np.int32), ("finish", np.int32)]


class _Collision(Exception):
    """Two different windows share a hash under this base."""


def _same(data: np.ndarray, s1: np.ndarray, s2: np.ndarray, sizes: np.ndarray, step: int = 50_000) -> bool:
    """Whether each range at s1 equals the range at s2, byte by byte."""
    for i in range(0, len(s1), step):
        one, _ = K.ragged(s1[i : i + step], sizes[i : i + step])
        two, _ = K.ragged(s2[i : i + step], sizes[i : i + step])
        if not np.array_equal(data[one], data[two]):
            return False
    return True


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _super_kmers(batch: pa.RecordBatch, window: int, m: int, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, windows, packed super-k-mers) of one slice of documents; a row of no windows holds packed ranges of repeated words."""
    data, offsets = K.flat(batch.column("text"))
    starts, ends, rows = K.spans(data, offsets, K.NOT_SPACE)
    if len(starts) < window:
        return
    text, at = K.joined(data, starts, ends)
    words = K.range_hash(text, at[:-1], at[1:] - 1)
    n = len(words) - m + 1
    grams = K.range_hash(words, np.arange(n), np.arange(m, n + m))
    smallest = _sliding_min(grams, window - m + 1)
    doc = np.repeat(np.arange(batch.num_rows), np.diff(rows))
    valid = np.flatnonzero(doc[: len(smallest)] == doc[window - 1 :])
    if not len(valid):
        return
    value = smallest[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (valid[1:] != valid[:-1] + 1) | (value[1:] != value[:-1]) | (doc[valid[1:]] != doc[valid[:-1]])
    first = np.flatnonzero(new)
    begin, count = valid[first], np.diff(np.append(first, len(valid)))
    finish = begin + count + window - 1
    b0, b1 = at[begin], at[finish] - 1
    key = K.range_hash(words, begin, finish)
    _, rep, group = np.unique(key, return_index=True, return_inverse=True)
    leader = rep[group]
    twins = np.flatnonzero(leader != np.arange(len(key)))
    if np.any((b1 - b0)[twins] != (b1 - b0)[leader[twins]]) or not _same(text, b0[twins], b0[leader[twins]], (b1 - b0)[twins]):
        rep, group = np.arange(len(key)), np.arange(len(key))
    bucket = (K.mix(value[first]) % np.uint64(buckets)).astype(np.int64)
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[doc[begin]]
    tags = batch.column("tag").to_numpy(zero_copy_only=False)[doc[begin]].astype(np.int32)
    places = (begin - rows[doc[begin]]).astype(np.int32)

    rep = rep[np.argsort(bucket[rep], kind="stable")]
    rank = np.empty(len(key), np.int64)
    rank[rep] = np.arange(len(rep))
    rank = rank[leader] if len(rep) < len(key) else rank
    order = np.argsort(rank, kind="stable")
    held = np.searchsorted(rank[order], np.arange(len(rep) + 1))
    late = ids[order] > np.repeat(np.minimum.reduceat(ids[order], held[:-1]), np.diff(held))
    gone = np.sort(order[late])
    order, held = order[~late], np.concatenate(([0], np.cumsum(~late)))[held]
    cuts = np.append(np.flatnonzero(np.diff(bucket[rep], prepend=-1)), len(rep))
    pack = zstandard.ZstdCompressor(level=6)
    if len(gone):
        joins = (begin[gone[1:]] == begin[gone[:-1]] + count[gone[:-1]]) & (doc[begin[gone[1:]]] == doc[begin[gone[:-1]]])
        head, tail = gone[np.append(True, ~joins)], gone[np.append(~joins, True)]
        ranges = ids[head].astype(np.int64), tags[head], places[head], (places[tail] + count[tail] + window - 1).astype(np.int32)
        yield int(K.mix(value[:1])[0] % np.uint64(buckets)), 0, pack.compress(b"".join(x.tobytes() for x in ranges))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        own, occ = rep[lo:hi], order[held[lo] : held[hi]]
        index, _ = K.ragged(b0[own], b1[own] - b0[own])
        head = np.array([len(own), len(occ), len(index)], np.int64)
        parts = (
            head, ids[occ].astype(np.int64), (b1 - b0)[own].astype(np.int32), np.diff(held[lo : hi + 1]).astype(np.int32),
            tags[occ], places[occ], text[index],
        )
        yield int(bucket[own[0]]), int(count[own].sum()), pack.compress(b"".join(x.tobytes() for x in parts))


class _Chunk:
    """Unpacked super-k-mers with their places and windows."""

    def __init__(self, packed: list[bytes], window: int, base: int) -> None:
        unpack, parts = zstandard.ZstdDecompressor(), []
        for blob in packed:
            raw = unpack.decompress(blob)
            n, occ, size = np.frombuffer(raw, np.int64, 3)
            own, at = [], 24
            for kind, length in ((np.int64, occ), (np.int32, n), (np.int32, n), (np.int32, occ), (np.int32, occ), (np.uint8, size)):
                own.append(np.frombuffer(raw, kind, length, at))
                at += own[-1].nbytes
            parts.append(own)
        self.doc, sizes, held, self.tag, self.place, self.text = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.held = np.concatenate(([0], np.cumsum(held, dtype=np.int64)))
        offsets = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        starts, ends, rows = K.spans(self.text, offsets, K.NOT_SPACE)
        words = K.range_hash(self.text, starts, ends, base)
        per = np.diff(rows) - window + 1
        first, self.offsets = K.ragged(rows[:-1], per)
        self.hash = K.range_hash(words, first, first + window, base)
        self.b0, self.b1 = starts[first], ends[first + window - 1]
        self.first = np.repeat(np.minimum.reduceat(self.doc, self.held[:-1]), per)
        self.window = window

    def _windows(self, occ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows at places ``occ``: the window, the place, and how many words after it the window starts."""
        group = np.repeat(np.arange(len(self.held) - 1), np.diff(self.held))[occ]
        per = np.diff(self.offsets)[group]
        index, offsets = K.ragged(self.offsets[group], per)
        return index, np.repeat(occ, per), np.arange(len(index)) - np.repeat(offsets[:-1], per)

    def repeats(self, earliest: np.ndarray) -> pa.RecordBatch | None:
        """Word ranges of documents whose windows start in an earlier one; earliest: of each window, the smallest doc_id."""
        least = np.minimum.reduceat(earliest, self.offsets[:-1])
        occ = np.flatnonzero(np.repeat(least, np.diff(self.held)) < self.doc)
        if not len(occ):
            return None
        index, owner, step = self._windows(occ)
        late = earliest[index] < self.doc[owner]
        begin, end = late.copy(), late.copy()
        begin[1:] &= ~late[:-1] | (owner[1:] != owner[:-1])
        end[:-1] &= ~late[1:] | (owner[1:] != owner[:-1])
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        at = self.place[owner[b]]
        return _found([self.doc[owner[b]], self.tag[owner[b]], at + step[b], at + step[e] + self.window])

    def each(self, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        """Every window at every place with its words."""
        for i in range(0, len(self.doc), most):
            index, owner, step = self._windows(np.arange(i, min(i + most, len(self.doc))))
            for j in range(0, len(index), most):
                k = slice(j, j + most)
                begin = self.place[owner[k]] + step[k]
                gram = K.gather(self.text, self.b0[index[k]], self.b1[index[k]]).cast(pa.binary())
                yield _found([self.doc[owner[k]], self.tag[owner[k]], begin, begin + self.window], gram)


def _found(ranges: list[np.ndarray], gram: pa.Array | None = None) -> pa.RecordBatch:
    own = [pa.array(x.astype(kind)) for x, (_, kind) in zip(ranges, _RANGE, strict=True)]
    return pa.RecordBatch.from_arrays([*own, pa.nulls(len(own[0]), pa.binary()) if gram is None else gram], names=[*(n for n, _ in _RANGE), "gram"])


def _sorted_out(chunks: list[_Chunk]) -> list[pa.RecordBatch]:
    """Sort the windows of one bucket and compare them with their places."""
    base_at = np.cumsum([0, *(len(c.text) for c in chunks)])
    hashed = np.concatenate([c.hash for c in chunks])
    order = np.argsort(hashed, kind="stable")
    ranked = hashed[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    lead = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    twins = np.flatnonzero(~new)
    a, b = order[twins], order[lead[group[twins]]]
    begin = np.concatenate([c.b0 + at for c, at in zip(chunks, base_at[:-1], strict=True)])
    size = np.concatenate([c.b1 - c.b0 for c in chunks])
    text = np.concatenate([c.text for c in chunks])
    if np.any(size[a] != size[b]) or not _same(text, begin[a], begin[b], size[a]):
        raise _Collision
    del text, begin, size, a, b
    least = np.minimum.reduceat(np.concatenate([c.first for c in chunks])[order], lead)
    earliest = np.empty(len(order), np.int64)
    earliest[order] = least[group]
    ends = np.cumsum([len(c.hash) for c in chunks])
    found = [c.repeats(own) for c, own in zip(chunks, np.split(earliest, ends[:-1]), strict=True)]
    return [x for x in found if x is not None]


def _compared(packed: list[bytes], window: int) -> list[pa.RecordBatch]:
    """The repeated ranges of one whole bucket."""
    runs = np.cumsum([len(x) for x in packed]) // _UNPACK
    for base in _BASES:
        try:
            return _sorted_out([_Chunk([x for _, x in g], window, base) for _, g in groupby(zip(runs, packed, strict=True), lambda x: x[0])])
        except _Collision:
            continue
    raise RuntimeError("windows collide under every hash base")


def _count_windows(batches: Iterator[pa.RecordBatch], window: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Exact window comparison of buckets that come one after another; windows of a bucket beyond ``limit`` leave with their words."""
    rows = (r for b in batches for r in zip(b.column("bucket").to_pylist(), b.column("windows").to_pylist(), b.column("packed"), strict=True))
    for _, bucket in groupby(rows, lambda r: r[0]):
        held, total = [], 0
        for _, windows, packed in bucket:
            if not windows:
                raw = zstandard.ZstdDecompressor().decompress(packed.as_py())
                n = len(raw) // sum(np.dtype(k).itemsize for _, k in _RANGE)
                at, ranges = 0, []
                for _, kind in _RANGE:
                    ranges.append(np.frombuffer(raw, kind, n, at))
                    at += ranges[-1].nbytes
                yield _found(ranges)
                continue
            held.append(packed.as_py())
            total += windows
            if total > limit:
                for x in held:
                    yield from _Chunk([x], window, _BASES[0]).each()
                held = []
        if held and total <= limit:
            yield from _compared(held, window)


def repeated_ranges(docs: DataFrame, window: int = 13, m: int = 2, limit: int = 2_000_000) -> DataFrame:
    """(doc_id, tag, begin, finish): word ranges covered by windows that start in a document with a smaller doc_id.

    ``limit`` bounds the windows sorted at once by a task; it changes no result.
    """
    parts = 4 * partitions(docs.sparkSession)
    known = docs.select("doc_id", _tag(), "text").where("doc_id is not null and text is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parts, size // (3 * limit))  # six bytes a word: on average half of the limit

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", 3 * K.SLICE_BYTES):
                if rows := list(_super_kmers(part, window, m, buckets)):
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "windows", "packed"])

    sent = known.mapInArrow(emit, "bucket long, windows long, packed binary")
    dealt = sent.repartitionById(parts, F.expr(f"int(bucket % {parts})")).sortWithinPartitions("bucket")
    found = written(dealt.mapInArrow(lambda it: _count_windows(it, window, limit), "doc_id long, tag int, begin int, finish int, gram binary"), "ranges")
    ranges, hot = found.where("gram is null").drop("gram"), found.where("gram is not null")
    if hot.isEmpty():
        return ranges
    first = hot.groupBy("gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return ranges.unionByName(hot.join(first, "gram").where("first < doc_id").select(*ranges.columns))


def _tag() -> F.Column:
    """Tells apart rows that repeat a doc_id with other texts."""
    return F.shiftright(F.xxhash64("text"), 32).cast("int").alias("tag")


def substring_dedup(docs: DataFrame, window: int = 13, m: int = 2, limit: int = 2_000_000) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): the text without the words covered by repeated windows.

    Windows are judged on the input; kept words are joined by one space.
    """
    ranges = repeated_ranges(docs, window, m, limit).groupBy("doc_id", "tag").agg(F.collect_list("begin").alias("begin"), F.collect_list("finish").alias("finish"))
    whole = docs.select("doc_id", _tag(), "text").join(ranges, ["doc_id", "tag"], "left").select("doc_id", "text", "begin", "finish")
    return whole.mapInArrow(_without, "doc_id long, n_words long, n_removed long, kept_text string")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, "text", 4 * K.SLICE_BYTES):
            data, offsets = K.flat(batch.column("text"))
            starts, ends, rows = K.spans(data, offsets, K.NOT_SPACE)
            counts = np.diff(rows)
            drop = np.zeros(len(starts) + 1, np.int64)
            begin, finish = batch.column("begin"), batch.column("finish")
            owner = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(begin), 0).to_numpy(zero_copy_only=False))
            np.add.at(drop, rows[owner] + pc.list_flatten(begin).to_numpy(zero_copy_only=False), 1)
            np.add.at(drop, rows[owner] + pc.list_flatten(finish).to_numpy(zero_copy_only=False), -1)
            keep = np.cumsum(drop)[:-1] == 0
            before = np.concatenate(([0], np.cumsum(keep)))
            left = before[rows]
            text, at = K.joined(data, starts[keep], ends[keep])
            b0, b1 = at[left[:-1]], at[left[1:]]
            kept = K.gather(text, b0, np.maximum(b0, b1 - 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(counts - np.diff(left)), kept.cast(pa.large_string()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
k AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS gram FROM w, unnest(range(1, len(words) - 11)) AS u(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM k) WHERE first < doc_id),
cut AS (SELECT doc_id, list(DISTINCT i + j) AS gone FROM late, unnest(range(0, 13)) AS v(j) GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(words) AS n, list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(coalesce(gone, []), x[2])) AS rest
         FROM w LEFT JOIN cut USING (doc_id))
SELECT doc_id, n AS n_words, n - len(rest) AS n_removed, sha256(array_to_string(list_transform(rest, lambda x: x[1]), ' ')) AS kept_sha256 FROM kept
"""
