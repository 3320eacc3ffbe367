"""Exact duplicates by mergeable counting quotient filters, then byte verification.

Every task fingerprints its documents (64 bits of the text without white space)
and builds a counting quotient filter: a fingerprint's high bits, the quotient,
choose its run; a run holds the sorted remainders with their counts. A filter is
cut by quotient into slices; the slices of all tasks are merged losslessly by
their sorted remainders, and counts add up. Fingerprints counted once are
unique texts. The others are routed to byte verification: equal texts of a batch
are combined first, then grouped by the text itself, so copies held by a third
of the corpus reach a task once a batch.

Defined cases: null counts as empty. The row with the most code points, then the
smallest doc_id (null last), stays; rows that repeat the keeper's doc_id within
its group count as the same document. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import partitions, sized, table, written

_WHITE = bytes([0x20, *range(0x09, 0x0E)])


class CountingQuotientFilter:
    """Sorted remainders with counts, in runs by quotient: the run lengths stand for the filter's metadata bits.

    Written out, a fingerprint takes the bytes of its remainder (six at 16 bits of
    quotient) and one for its count; counts of 255 and more follow in a list. The
    quotients take a run length each, whatever the filter holds.
    """

    def __init__(self, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, first: int = 0) -> None:
        self.bits, self.runs, self.remainders, self.counts, self.first = quotient_bits, runs, remainders, counts, first

    @staticmethod
    def build(fingerprints: np.ndarray, quotient_bits: int) -> CountingQuotientFilter:
        """The filter of all quotients for fingerprints in any order."""
        return CountingQuotientFilter._of(np.sort(fingerprints), np.ones(len(fingerprints), np.int64), quotient_bits, 0, 1 << quotient_bits)

    @staticmethod
    def _of(ranked: np.ndarray, counts: np.ndarray, quotient_bits: int, first: int, quotients: int) -> CountingQuotientFilter:
        """From sorted fingerprints: those that are equal add their counts."""
        lead = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
        total = np.add.reduceat(counts, lead) if len(lead) else np.empty(0, np.int64)
        shift = np.uint64(64 - quotient_bits)
        quotient = (ranked[lead] >> shift).astype(np.int64) - first
        return CountingQuotientFilter(quotient_bits, np.bincount(quotient, minlength=quotients), ranked[lead] & ((np.uint64(1) << shift) - np.uint64(1)), total, first)

    def fingerprints(self) -> np.ndarray:
        """In ascending order."""
        quotient = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.first), self.runs)
        return (quotient << np.uint64(64 - self.bits)) | self.remainders

    def slices(self, n: int) -> Iterator[tuple[int, bytes]]:
        """n equal ranges of quotients, serialised; empty ones are left out."""
        width = len(self.runs) // n
        at = np.concatenate(([0], np.cumsum(self.runs)))
        wide = (64 - self.bits + 7) // 8
        for i in range(n):
            lo, hi = at[i * width], at[(i + 1) * width]
            if hi > lo:
                runs, counts = self.runs[i * width : (i + 1) * width], self.counts[lo:hi]
                many = counts[counts >= 255]
                head = np.array([self.bits, i * width, width, hi - lo, len(many)], np.int64)
                packed = self.remainders[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]
                yield i, b"".join(x.tobytes() for x in (head, runs.astype("<u4"), packed, np.minimum(counts, 255).astype(np.uint8), many.astype("<i8")))

    @staticmethod
    def read(raw: bytes) -> CountingQuotientFilter:
        bits, first, width, n, many = (int(x) for x in np.frombuffer(raw, np.int64, 5))
        wide, at = (64 - bits + 7) // 8, 40
        runs = np.frombuffer(raw, "<u4", width, at)
        at += runs.nbytes
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :wide] = np.frombuffer(raw, np.uint8, n * wide, at).reshape(n, wide)
        at += n * wide
        counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
        counts[counts == 255] = np.frombuffer(raw[at + n :], "<i8", many)
        return CountingQuotientFilter(bits, runs, remainders.view("<u8").ravel(), counts, first)

    def merged(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Of one range of quotients: the sorted remainders of both are merged into place and counts of equal ones added; nothing is lost."""
        own, theirs = self.fingerprints(), other.fingerprints()
        place = np.searchsorted(own, theirs)
        return CountingQuotientFilter._of(np.insert(own, place, theirs), np.insert(self.counts, place, other.counts), self.bits, self.first, len(self.runs))

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """Neighbours first, so that each remainder takes part in few merges."""
        while len(filters) > 1:
            filters = [a.merged(b) for a, b in zip(filters[::2], filters[1::2], strict=False)] + filters[len(filters) // 2 * 2 :]
        return filters[0]


def _normal(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").translate(None, _WHITE) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]


def _fingerprint(texts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, "text", 4 * K.SLICE_BYTES):
            texts = _normal(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("n"), pa.array(_fingerprint(texts).view(np.int64)), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                names=["doc_id", "n", "fp", "digest"],
            )


def repeated_fingerprints(fps: DataFrame, quotient_bits: int = 16) -> DataFrame:
    """(fp, n): the values of the long column ``fp`` that occur more than once, by merged counting quotient filters."""
    slices = min(1 << quotient_bits, 1 << (4 * partitions(fps.sparkSession) - 1).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            rows = list(CountingQuotientFilter.build(np.concatenate(held).view(np.uint64), quotient_bits).slices(slices))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "filter"])

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= 1_000_000:
                yield out()
                held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # filters wait until together they are as large as what is merged: each remainder takes part in few merges
        merged: dict[int, list[CountingQuotientFilter]] = {}
        for batch in batches:
            for i, raw in zip(batch.column("slice").to_pylist(), batch.column("filter").to_pylist(), strict=True):
                own = merged.setdefault(i, [])
                own.append(CountingQuotientFilter.read(raw))
                if len(own) > 1 and sum(len(f.counts) for f in own[1:]) >= len(own[0].counts) + 100_000:
                    merged[i] = [CountingQuotientFilter.merge(own)]
        for own in merged.values():
            f = CountingQuotientFilter.merge(own)
            many = f.counts > 1
            yield pa.RecordBatch.from_arrays([pa.array(f.fingerprints()[many].view(np.int64)), pa.array(f.counts[many])], names=["fp", "n"])

    return fps.select("fp").mapInArrow(build, "slice int, filter binary").repartition("slice").mapInArrow(merge, "fp long, n long")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a batch as one row: best is the keeper's (code points, doc_id)."""
    for whole in batches:
        for batch in K.slices(whole, "text", 4 * K.SLICE_BYTES):
            best: dict[bytes, list] = {}
            for t, n, d in zip(_normal(batch), batch.column("n").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                rank = (-n, d is None, d or 0)
                have = best.get(t)
                if have is None:
                    best[t] = [rank, 1]
                else:
                    have[0] = min(have[0], rank)
                    have[1] += 1
            texts = list(best)
            ranks = [v[0] for v in best.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(_fingerprint(texts).view(np.int64)), pa.array(texts, pa.binary()), pa.array([-r[0] for r in ranks], pa.int32()), pa.array([None if r[1] else r[2] for r in ranks], pa.int64()), pa.array([v[1] for v in best.values()], pa.int64())],
                names=["fp", "normal", "n", "doc_id", "size"],
            )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each document."""
    given = docs.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    meta = written(given.mapInArrow(_described, "doc_id long, n int, fp long, digest binary"), "described")
    many = written(repeated_fingerprints(meta), "repeated")
    routed = given.mapInArrow(_combined, "fp long, normal binary, n int, doc_id long, size long").join(sized(many.select("fp"), 16), "fp", "left_semi")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id"))
    verified = routed.groupBy("fp", "normal").agg(best.alias("best"), F.sum("size").alias("group_size")).where("group_size > 1")
    groups = verified.select(F.unhex(F.sha2("normal", 256)).alias("digest"), F.col("best.doc_id").alias("keep_id"), "group_size", F.lit(True).alias("grouped"))
    return meta.join(sized(written(groups, "groups"), 80), "digest", "left").select(
        "doc_id",
        F.when(F.col("grouped"), F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("grouped").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY len DESC, doc_id)
"""
