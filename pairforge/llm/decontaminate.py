"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are lower-cased runs of letters and
digits. Seeds are runs of ``k`` words that a document shares with an item. For
each document and item with enough seeds, tiles are laid: the longest match of
words not yet marked in either text is marked, again and again, down to ``k``
words; the length of the longest match is searched for by running Karp-Rabin
hashes, and what matches by hash is compared word for word. Tiles may come in any
order, so a passage whose parts are moved around is still covered. An item is
found in a document if tiles cover at least ``coverage`` of its words.

The benchmark is a stated query set: its distinct texts are cut into blocks of
about ``block_words`` words. A benchmark of one block is run over all documents.
Of a larger one, the seeds of all blocks go into a sieve of bounded size first; one
pass over the documents writes those that hold as many of its seeds as the shortest
item needs, and each block is run over these alone. The sieve lets too many pass
when it is full, never too few; there is no limit on the number of blocks, and the
driver holds one at a time.

Defined cases: null or empty texts share nothing; an item of fewer than ``k``
words is never found; items of equal text are found together; a row is returned
for each document row; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import positional, sized, table, written

SEED_WORDS = 5
COVERAGE = 0.8
BLOCK_WORDS = 200_000
#: 64 MB of bits.
SIEVE_BITS = 29


class Texts:
    """Words of many texts: their hashes, the offsets of each row's, and their bytes."""

    def __init__(self, array: pa.Array) -> None:
        data, offsets = K.flat(array)
        self.data = K.LOWER[data]
        self.starts, self.ends, self.cut = K.spans(self.data, offsets, K.ALNUM)
        self.words = K.word_hash(self.data, self.starts, self.ends) if len(self.starts) else np.empty(0, np.uint64)

    def row(self, i: int) -> np.ndarray:
        return self.words[self.cut[i] : self.cut[i + 1]]

    def spelled(self, at: np.ndarray) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, row, place in the row) of all runs of k words within rows."""
        per = np.maximum(np.diff(self.cut) - k + 1, 0)
        at, _ = K.ragged(self.cut[:-1], per)
        row = np.repeat(np.arange(len(per)), per)
        return K.range_hash(self.words, at, at + k) if len(at) else np.empty(0, np.uint64), row, at - self.cut[row]


def _first_match(text: np.ndarray, pattern: np.ndarray, free_t: np.ndarray, free_p: np.ndarray, length: int) -> tuple[int, int] | None:
    """Where unmarked words match over ``length`` words: the first place in the pattern, then in the text."""

    def windows(words: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate(([0], np.cumsum(~free)))
        at = np.flatnonzero(taken[length:] == taken[: len(taken) - length])
        return (K.range_hash(words, at, at + length) if len(at) else np.empty(0, np.uint64)), at

    if length > min(len(text), len(pattern)):
        return None
    h_p, at_p = windows(pattern, free_p)
    h_t, at_t = windows(text, free_t)
    for i in np.flatnonzero(np.isin(h_p, h_t)).tolist():
        for t in at_t[h_t == h_p[i]].tolist():
            p = int(at_p[i])
            if np.array_equal(text[t : t + length], pattern[p : p + length]):
                return t, p
    return None


def tiles(text: np.ndarray, pattern: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(place in text, place in pattern, words) of the tiles that greedy tiling lays, none shorter than k."""
    free_t, free_p = np.ones(len(text), bool), np.ones(len(pattern), bool)
    out: list[tuple[int, int, int]] = []
    most = min(len(text), len(pattern))
    while most >= k:
        found, low, high = _first_match(text, pattern, free_t, free_p, most), k, most
        if found is None:  # a match of n words holds matches of fewer: search for the greatest n
            high -= 1
            while low <= high:
                half = (low + high + 1) // 2
                if (at := _first_match(text, pattern, free_t, free_p, half)) is not None:
                    found, most, low = at, half, half + 1
                else:
                    high = half - 1
        if found is None:
            return out
        t, p = found
        free_t[t : t + most] = free_p[p : p + most] = False
        out.append((t, p, most))
    return out


class Block:
    """Texts of one block of the benchmark and the postings of their seeds."""

    def __init__(self, items: list[tuple[int, str]], k: int) -> None:
        self.keys, self.k = [i for i, _ in items], k
        self.texts = Texts(pa.array([t for _, t in items], pa.string()))
        gram, row, _ = self.texts.grams(k)
        self.own, self.begin = gram, np.searchsorted(row, np.arange(len(items) + 1))  # of each item, in order
        order = np.lexsort((row, gram))
        gram, row = gram[order], row[order]
        lead = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (row[1:] != row[:-1]))) if len(gram) else np.empty(0, np.int64)
        self.grams, self.row, self.times = gram[lead], row[lead], np.diff(np.append(lead, len(gram)))

    def found(self, docs: Texts, coverage: float) -> Iterator[tuple[int, int, float]]:
        """(row, key of the item, share of its words covered) of the items found in rows of documents."""
        k = self.k
        grams, row, place = docs.grams(k)
        if not len(self.grams) or not len(grams):
            return
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[at] == grams)
        if not len(hit):
            return
        order = np.lexsort((grams[hit], row[hit]))
        hit = hit[order]
        hit = hit[np.append(True, (grams[hit][1:] != grams[hit][:-1]) | (row[hit][1:] != row[hit][:-1]))]  # each gram once a document
        lo = np.searchsorted(self.grams, grams[hit], "left")
        per = np.searchsorted(self.grams, grams[hit], "right") - lo
        posting, _ = K.ragged(lo, per)
        doc, item, shared = np.repeat(row[hit], per), self.row[posting], np.repeat(grams[hit], per)
        order = np.lexsort((shared, item, doc))
        doc, item, shared, times = doc[order], item[order], shared[order], self.times[posting][order]
        edges = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])))
        words = np.diff(self.texts.cut)[item[edges]]
        enough = np.add.reduceat(times, edges) * k >= coverage * words
        for a, b, n in zip(edges[enough].tolist(), np.append(edges[1:], len(doc))[enough].tolist(), words[enough].tolist(), strict=True):
            i, d, mine = int(item[a]), int(doc[a]), shared[a:b]
            in_document = np.flatnonzero(np.isin(self.own[self.begin[i] : self.begin[i + 1]], mine))
            able = np.zeros(n, bool)
            able[in_document[:, None] + np.arange(k)] = True
            if able.mean() < coverage:  # tiles can't cover more than the seeds do
                continue
            first, last = np.searchsorted(row, (d, d + 1))
            seeds = place[first:last][np.isin(grams[first:last], mine)]
            own = docs.row(d)
            seeded = np.zeros(len(own) + 1, bool)
            for step in range(k):
                seeded[seeds + step] = True
            keep = np.flatnonzero(seeded[:-1] | np.append(False, seeded[:-2]))  # a word after each seeded stretch keeps stretches apart
            text = np.where(seeded[:-1][keep], own[keep], np.uint64(0))
            covered = 0
            for t, p, size in tiles(text, self.texts.row(i), k):
                same = zip(docs.spelled(docs.cut[d] + keep[t : t + size]), self.texts.spelled(self.texts.cut[i] + np.arange(p, p + size)), strict=True)
                covered += sum(x == y for x, y in same)
            if covered >= coverage * n:
                yield d, self.keys[i], covered / n


def blocks(items: DataFrame, k: int, block_words: int) -> Iterator[Block]:
    """Distinct texts (key, text, n words) in blocks of about ``block_words`` words, one on the driver at a time."""
    n = max(1, -(-(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    for i in range(n):
        yield Block(sorted(tuple(r) for r in items.where(F.pmod("key", F.lit(n)) == i).select("key", "text").collect()), k)


class Sieve:
    """Seeds by four bits each in at most 2**``SIEVE_BITS`` bits: those put in are held, and few others."""

    def __init__(self, seeds: int) -> None:
        self.bits = min(SIEVE_BITS, max(16, (16 * seeds).bit_length()))
        self.map = np.zeros(1 << self.bits - 3, np.uint8)

    def _places(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93):
            at = (grams * np.uint64(odd)) >> np.uint64(64 - self.bits)
            yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)

    def add(self, grams: np.ndarray) -> None:
        for byte, bit in self._places(grams):
            np.bitwise_or.at(self.map, byte, bit)

    def holds(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), bool)
        for byte, bit in self._places(grams):
            out &= (self.map[byte] & bit) != 0
        return out


def _sieved(sieve, k: int, least: int):
    """The rows that hold at least so many seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                grams, row, _ = Texts(batch.column("text")).grams(k)
                many = np.bincount(row[sieve.value.holds(grams)], minlength=batch.num_rows)
                if (many >= least).any():
                    yield batch.filter(pa.array(many >= least))

    return run


def suspects(given: DataFrame, items: DataFrame, k: int, coverage: float, block_words: int) -> DataFrame:
    """The documents that may hold an item, written: they have as many seeds as tiles need to cover the shortest item."""
    sieve = Sieve(items.agg(F.sum("n")).first()[0] or 0)
    shortest = None
    for block in blocks(items, k, block_words):
        sieve.add(block.grams)
        words = np.diff(block.texts.cut)
        shortest = min([*words[words >= k].tolist(), *([shortest] if shortest else [])], default=None)
    least = max(1, ceil(ceil(coverage * (shortest or 0) - 1e-9) / (2 * k - 1)))
    shared = given.sparkSession.sparkContext.broadcast(sieve)
    return written(given.mapInArrow(_sieved(shared, k, least), given.schema), "suspects")


def _searched(block: Block, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                found = list(block.found(Texts(batch.column("text")), coverage))
                if found:
                    rows = pa.array([r for r, _, _ in found])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("tag").take(rows), pa.array([i for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found])], names=["doc_id", "tag", "key", "share"])

    return run


def hits(given: DataFrame, benchmark: DataFrame, k: int, coverage: float, block_words: int) -> DataFrame:
    """(hit_id, hit_tag, items, coverage) of the documents (doc_id, tag, text) that hold an item; items: their ids, ascending."""
    own = benchmark.where("text is not null").select("item_id", F.xxhash64("text").alias("key"), "text")
    items = written(own.groupBy("key").agg(F.min("text").alias("text")).withColumn("n", F.size(F.split("text", r"\s+"))), "items")
    out = None
    if (items.agg(F.sum("n")).first()[0] or 0) > block_words:
        given = suspects(given, items, k, coverage, block_words)
    for block in blocks(items, k, block_words):
        found = written(given.mapInArrow(_searched(block, coverage), "doc_id long, tag long, key long, share double"), "hits")
        out = found if out is None else out.unionByName(found)
    named = out.distinct().join(own.select("key", "item_id"), "key")  # rows that repeat an id and a text have the same hits
    one = F.struct(F.col("item_id").isNull().alias("none"), F.col("item_id").cast("long").alias("item_id"))  # a list of plain ids would lose null
    ids = F.array_sort(F.collect_list(one)).getField("item_id").alias("items")
    return written(named.groupBy(F.col("doc_id").alias("hit_id"), F.col("tag").alias("hit_tag")).agg(ids, F.max("share").alias("coverage")), "found")


def _tagged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs by position with doc_id and tag, and (doc_id, tag, text) for the search."""
    plain, name = positional(docs)
    tagged = plain.withColumn("tag", F.xxhash64(name["text"])).withColumn("doc_id", F.col(name["doc_id"]).cast("long"))
    return tagged, tagged.select("doc_id", "tag", F.col(name["text"]).alias("text"))


def search(docs: DataFrame, benchmark: DataFrame, k: int = SEED_WORDS, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with items (ids found in the text, ascending) and coverage (the highest share, 0 if none is found).

    Where ``docs`` has a column of such a name, whatever its case, the added one is called items_found or coverage_found, with more of ``_found`` until it is free.
    """
    tagged, given = _tagged(docs)
    found = hits(given, benchmark, k, coverage, block_words)
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag"))
    out = tagged.join(sized(found, 64), on, "left")
    added = F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage")
    names, taken = [], {c.lower() for c in docs.columns}
    for name in ("items", "coverage"):
        while name in taken:
            name += "_found"
        names.append(name)
    return out.select(*(f"c{i}" for i in range(len(docs.columns))), *added).toDF(*docs.columns, *names)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The columns of ``docs``, without the rows that hold a benchmark item."""
    tagged, given = _tagged(docs)
    found = hits(given, benchmark, SEED_WORDS, COVERAGE, BLOCK_WORDS)
    on = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("tag") == F.col("hit_tag"))
    left = tagged.join(sized(found.select("hit_id", "hit_tag"), 64), on, "left_anti")
    return left.select(*(f"c{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("item_ids"), "coverage")
