"""Resampling documents towards a target distribution by importance weights of hashed word n-grams.

Features are the runs of one to three words; a feature's bucket is the CRC-32 of
its bytes modulo the number of buckets. A bucket's gain is the logarithm of its
smoothed rate in the target over that in the documents, and a document's weight
the sum of its features' gains. Gumbel noise drawn from the id turns the highest
scores into a sample without replacement.

CRC-32 is linear over XOR: a byte's part in it hangs on the byte and on its
distance from the span's end only. So a table by distance and byte holds every
part, the parts of all spans of a block are looked up at once and XORed span by
span, and a constant for each length stands for the register's start and finish.
Spans longer than the table are folded block by block: the register moves over a
block of zeros by four look-ups in the same table.

Two passes over the texts (rates, weights) keep nothing but a histogram a task
and one narrow row a document; the gains are one number a bucket.

Defined cases: null or empty text has no features, weight 0 and no rank; rows
that repeat a doc_id each count and tie among themselves in any order; a null
doc_id draws its noise as an empty one and comes after others on ties; with an
empty target the gains follow from the smoothing alone; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.indexing import dense_index
from pairforge.llm import kernel as K
from pairforge.llm.common import table, written

BUCKETS = 10_000
#: Most words of a feature.
ORDER = 3
#: Words of the shortest document that can be drawn, and the share that is, in hundredths.
MIN_WORDS, PERCENT = 20, 5
SEED = 42

#: Bytes from a span's end that the table covers.
REACH = 64
#: Words handled at once.
_BLOCK = 1 << 15


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Parts in the register by distance from the end (times 256, plus the byte), and the constant of each length."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    parts = np.empty((REACH, 256), np.uint32)
    parts[0] = step
    for d in range(1, REACH):  # one more byte of zeros behind
        parts[d] = (parts[d - 1] >> 8) ^ step[parts[d - 1] & 0xFF]
    start = np.empty(REACH + 1, np.uint32)
    start[0] = 0xFFFFFFFF
    for n in range(REACH):
        start[n + 1] = (start[n] >> 8) ^ step[start[n] & 0xFF]
    return parts.ravel(), start ^ np.uint32(0xFFFFFFFF)


_PARTS, _CONSTANT = _tables()


def _over_zeros(register: np.ndarray) -> np.ndarray:
    """The register after ``REACH`` bytes of zeros: its own bytes stand for the first four."""
    out = np.zeros_like(register)
    for i in range(4):
        out ^= _PARTS[(REACH - 1 - i) * 256 + ((register >> np.uint32(8 * i)) & np.uint32(0xFF)).astype(np.int64)]
    return out


def _xored(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XOR of the parts of spans of 1 to ``REACH`` bytes."""
    index, offsets = K.ragged(starts, ends - starts)
    at = np.repeat(ends - 1, ends - starts)
    at -= index
    at <<= 8
    at += data[index]
    return np.bitwise_xor.reduceat(_PARTS[at], offsets[:-1])


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of ``data``, as zlib gives it."""
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    short = np.flatnonzero((size > 0) & (size <= REACH))
    if len(short) == len(size):
        return _xored(data, starts, ends) ^ _CONSTANT[size] if len(size) else out
    if len(short):
        out[short] = _xored(data, starts[short], ends[short]) ^ _CONSTANT[size[short]]
    left = np.flatnonzero(size > REACH)
    if len(left):
        # the first block takes what is over, so that all others are full; the start of the register is folded with it
        lead = (size[left] - 1) % REACH + 1
        at, end, register = starts[left] + lead, ends[left], _CONSTANT[lead] ^ np.uint32(0xFFFFFFFF)
        register ^= _xored(data, starts[left], at)
        while len(left):
            register = _over_zeros(register) ^ _xored(data, at, at + REACH)
            at = at + REACH
            done = at == end
            out[left[done]] = register[done] ^ np.uint32(0xFFFFFFFF)
            left, at, end, register = left[~done], at[~done], end[~done], register[~done]
    return out


def _features(texts: pa.Array, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In blocks: rows' offsets of words, the words at which features begin, and the features' buckets."""
    data, offsets = K.flat(texts)
    data = K.LOWER[data]
    starts, ends, rows = K.spans(data, offsets, K.ALNUM)
    after = np.repeat(rows[1:], np.diff(rows))  # the first word of the next row
    for lo in range(0, len(starts), _BLOCK):
        hi = min(lo + _BLOCK, len(starts))
        to = min(hi + ORDER - 1, len(starts))
        joined, place = K.joined(data, starts[lo:to], ends[lo:to])
        for n in range(1, ORDER + 1):
            word = np.arange(lo, hi)
            word = word[word + n <= after[lo:hi]]
            yield rows, word, crc32(joined, place[word - lo], place[word - lo + n] - 1) % np.uint32(buckets)
    if not len(starts):
        yield rows, np.empty(0, np.int64), np.empty(0, np.uint32)


def _histogram(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in K.slices(whole, "text"):
                for _, _, bucket in _features(batch.column("text"), buckets):
                    total += np.bincount(bucket, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over all rows of the column ``text``: one histogram a task, added up; ``buckets`` rows reach the driver at most."""
    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(_histogram(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed rates, by bucket, rounded down."""
    s_all, t_all, n = float(docs.sum()), float(target.sum()), len(docs)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(docs.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                weight = None
                for rows, word, bucket in _features(batch.column("text"), len(gain)):
                    if weight is None:
                        weight = np.zeros(int(rows[-1]), np.int64)  # by the word a feature begins at
                    weight[word] += gain[bucket]
                run_up = np.concatenate(([0], np.cumsum(weight)))
                words = np.diff(rows).astype(np.int64)
                features = sum(np.maximum(words - n, 0) for n in range(ORDER))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(features), pa.array(run_up[rows[1:]] - run_up[rows[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each document; rank: 1, 2, 3 … of those drawn, else null."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(given, buckets), bucket_counts(target, buckets))
    weighed = given.mapInArrow(_weighed(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("tag", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    placed = dense_index(scored, [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tag").asc()], "place")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))


def op12_resampling(spark, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
