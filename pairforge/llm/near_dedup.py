"""Near-duplicates by the Jaccard similarity of five-word shingle sets, verified exactly.

Each set has a SimHash fingerprint over its shingles, and the pairs that the
generalised pigeonhole index of ``simhash`` gives within ``RADIUS`` bits are
compared on the shingles themselves. That settles the nearest copies. At
similarity 0.8 two fingerprints of 64 bits differ by about 10 bits, a radius at
which a pigeonhole index meets nearly everything, so what the fingerprints leave
apart is completed by MinHash: ``BANDS`` keys of ``ROWS`` minima each.
Two sets of similarity s share a key with probability 1 - (1 - s**ROWS)**BANDS,
all but 3 in 100,000 pairs at 0.8, fewer above. Sets that share a key are
compared in the same way, but where all sets of a key are connected already, and
components are taken of all links.

Texts of equal shingle sets are one set, so copies cost nothing. The sets of a
key travel as packed text to one task, which counts the shingles that one set
shares with all others at once, and gives out a link only where it connects
what was not connected: a large family gives links in proportion to its size.
A key of many sets is cut into blocks by hash, and each two blocks meet in a task
of their own, so that a task's memory is bounded and no pair of a key is left out.

Where blocks are more than ``NARROW_BLOCKS`` (a frequent passage, a family of
thousands of different sets), each block is first searched for itself, then one
set of each component found so far, as long as that halves what is left. Of sets
that are still apart only those can be similar that share one of their rarest
shingles (the prefix filter: of n shingles all but ceil(0.8 n), and one; in the
smaller set all but ceil(8n / 9), and one), so the rest needs no text. Sets connected by rare shared shingles are a family, in which
all outside its largest component meet all others, again in blocks.

Defined cases: words are lower-cased runs of anything but white space; a text of
fewer than five words is one shingle; null and texts without a word are equal;
a null doc_id stays only where its group has no other; an empty table stays
empty; columns of any name and type are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm import simhash
from pairforge.llm.common import positional, sized, written
from pairforge.llm.graph import components

SHINGLE = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 20, 4
#: Bits by which fingerprints of candidates differ at most.
RADIUS = 4
#: Sets and shingles of a block, about; a task compares two blocks at once.
BLOCK_SETS, BLOCK_SHINGLES = 1_000, 400_000
#: Blocks of a key up to which each meets each other; beyond, components and rare shingles narrow the search first.
NARROW_BLOCKS = 3

_RNG = np.random.default_rng(42)
_TIMES, _PLUS = (_RNG.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
_TIMES |= np.uint64(1)


def _shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, and the offsets of each text's."""
    data, offsets = K.flat(texts)
    data = K.LOWER[data]
    starts, ends, cut = K.spans(data, offsets, K.NOT_SPACE)
    words = K.word_hash(data, starts, ends) if len(starts) else np.empty(0, np.uint64)
    n = np.diff(cut)
    first, at = K.ragged(cut[:-1], np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1)))
    size = np.repeat(np.minimum(n, shingle), np.diff(at))
    return K.range_hash(words, first, first + size) if len(first) else np.empty(0, np.uint64), at


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                h, at = _shingles(batch.column("text"), shingle)
                sets = [_distinct(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                sid = K.mix(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64))
                n = np.array([len(s) for s in sets], np.int32)
                fp = simhash.majority(np.concatenate(sets), np.concatenate(([0], np.cumsum(n, dtype=np.int64))))
                some = np.flatnonzero(np.diff(at))
                keys = np.zeros((batch.num_rows, BANDS), np.uint64)
                if len(some):
                    now = np.empty_like(h)
                    for i, (times, plus) in enumerate(zip(_TIMES, _PLUS, strict=True)):
                        np.multiply(h, times, out=now)
                        now += plus
                        keys[some, i // ROWS] = K.mix(keys[some, i // ROWS] + np.minimum.reduceat(now, at[some]) + np.uint64(i))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), batch.column("tag"), pa.array(sid.view(np.int64)), pa.array(n), pa.array(fp.view(np.int64)), bands],
                    names=["doc_id", "tag", "sid", "n", "fp", "bands"],
                )
        K.release()

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for batch in K.slices(whole, "text"):
            texts = batch.column("text").cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array([pack.compress(t.as_py() or b"") for t in texts], pa.binary())], names=["sid", "packed"])
    K.release()


def spanning_links(sets: list[np.ndarray], similarity: tuple[int, int]) -> Iterator[tuple[int, int]]:
    """Pairs of similar sets that connect all sets which chains of similar sets connect.

    A set outside the largest component is compared with all others at once, by
    counting over the sets that hold each of its shingles.
    """
    size = np.array([len(s) for s in sets])
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.bincount(shingle)
    owner = np.repeat(np.arange(len(sets)), size)
    begin = np.concatenate(([0], np.cumsum(holders)))
    held_by = owner[np.argsort(shingle, kind="stable")]
    first = np.concatenate(([0], np.cumsum(size)))
    label, met = np.arange(len(sets)), np.zeros(len(sets), bool)
    while True:
        left = np.flatnonzero((label != np.bincount(label).argmax()) & ~met)
        if not len(left):
            return
        x = left[0]
        met[x] = True
        own = shingle[first[x] : first[x + 1]]
        own = own[holders[own] > 1]
        index, _ = K.ragged(begin[own], holders[own])
        shared = np.bincount(held_by[index], minlength=len(sets))
        hit = np.flatnonzero((shared * sum(similarity) >= (size + size[x]) * similarity[0]) & (label != label[x]))
        merged, one = np.unique(label[hit], return_index=True)
        label[np.isin(label, merged)] = label[x]
        for y in hit[one].tolist():
            yield int(x), y


def _linked(shingle: int, similarity: tuple[int, int]):
    def links(sids: list[np.ndarray], packed: list[bytes]) -> pa.RecordBatch | None:
        sid, one = np.unique(np.concatenate(sids), return_index=True)
        if len(sid) < 2:
            return None
        unpack = zstandard.ZstdDecompressor()
        h, at = _shingles(pa.array([unpack.decompress(packed[i]) for i in one.tolist()], pa.large_binary()), shingle)
        found = list(spanning_links([_distinct(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], similarity))
        if not found:
            return None
        return pa.RecordBatch.from_arrays([pa.array(sid[list(x)]) for x in zip(*found, strict=True)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sids, packed = None, [], []
        for batch in batches:
            gid, own = batch.column("gid").to_numpy(), batch.column("sid").to_numpy()
            cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if gid[a] != group:
                    if sids and (out := links(sids, packed)):
                        yield out
                    group, sids, packed = gid[a], [], []
                sids.append(own[a:b])
                packed += batch.column("packed").slice(a, b - a).to_pylist()
        if sids and (out := links(sids, packed)):
            yield out
        K.release()

    return run


def _set_shingles(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sids, held = [], []

        def out() -> pa.RecordBatch:
            n = np.array([len(h) for h in held], np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(sids, np.int64), n)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(held).view(np.int64))], names=["sid", "n", "shingle"])

        for batch in batches:
            for sid, packed in zip(batch.column("sid").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                sids.append(sid)
                held.append(_distinct(_shingles(pa.array([unpack.decompress(packed)], pa.large_binary()), shingle)[0]))
                if sum(map(len, held[-100:])) > BLOCK_SHINGLES or len(held) >= 100:
                    yield out()
                    sids.clear()
                    held.clear()
        if held:
            yield out()

    return run


def _blocks(sets: Column, shingles: Column) -> Column:
    return F.least(sets, F.greatest(F.ceil(sets / BLOCK_SETS), F.ceil(shingles / BLOCK_SHINGLES))).cast("int")


def _block(blocks: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(blocks)).cast("int")


def _in_families(members: DataFrame, packed: DataFrame, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(sid, n, label, family): members (sid, n, label) that may be similar to one of another label; such sets share a family."""
    postings = written(packed.join(members, "sid", "left_semi").mapInArrow(_set_shingles(shingle), "sid long, n int, shingle long").distinct(), "postings")
    often = postings.groupBy("shingle").agg(F.count("*").alias("sets"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy("sets", "shingle"))
    a, b = similarity
    among = F.expr(f"n - ({a} * n + {b - 1}) div {b} + 1")
    # against a set that is not smaller, fewer shingles decide
    early = F.expr(f"place <= n - ({2 * a} * n + {a + b - 1}) div {a + b} + 1")
    rarest = postings.join(often, "shingle").withColumn("place", place).where(F.col("place") <= among)
    rarest = written(rarest.select("sid", "shingle", early.alias("early")).join(members.select("sid", "label"), "sid"), "rarest")
    differ = rarest.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.max("early").alias("early")).where("a <> b and early").select("shingle")
    families = components(rarest.join(differ, "shingle").select(F.col("sid").alias("u"), F.col("shingle").alias("v")))
    return written(members.join(families.select(F.col("node").alias("sid"), F.col("root").alias("family")).distinct(), "sid"), "families")


def _outside_to_all(group: DataFrame) -> DataFrame:
    """(sid, gid): blocks in which each set outside its family's largest component meets all sets of the family."""
    parts = group.groupBy("family", "label").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    parts = parts.groupBy("family").agg(F.max(F.struct("m", "s", "label")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s")).where("m > top.m")
    inner, outer = _blocks(F.col("top.m"), F.col("top.s")), _blocks(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"))
    sizes = written(parts.select("family", F.col("top.label").alias("largest"), inner.alias("inner_blocks"), outer.alias("outer_blocks")), "sizes")
    rows = group.join(sized(sizes, 40), "family")
    inside = rows.where("label = largest").withColumn("b", _block("inner_blocks"))
    inside = inside.select("sid", "family", F.expr("explode(sequence(0, outer_blocks - 1))").alias("x"), (-1 - F.col("b")).alias("y"))
    outside = rows.where("label <> largest").withColumn("b", _block("outer_blocks"))
    outside = outside.select("sid", "family", "b", F.expr("explode(sequence(-inner_blocks, outer_blocks - 1))").alias("j"))
    outside = outside.select("sid", "family", F.when(F.col("j") < 0, F.col("b")).otherwise(F.least("b", "j")).alias("x"), F.when(F.col("j") < 0, F.col("j")).otherwise(F.greatest("b", "j")).alias("y"))
    return inside.unionByName(outside).select("sid", F.xxhash64("family", "x", "y").alias("gid"))


def _wide_links(wide: DataFrame, found: DataFrame, packed: DataFrame, compared: Callable[[DataFrame], DataFrame], shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """``found`` and what connects the sets of wide keys (sid, key, n, blocks) beyond it; ``compared`` links the sets of each gid."""
    # in the first round a set goes with one of its keys, the one of most blocks
    left = wide.groupBy("sid").agg(F.max(F.struct("blocks", "key")).alias("most")).select("sid", "most.key", "most.blocks")
    rows, depth = wide.count(), 0
    while True:
        found = found.unionByName(compared(left.select("sid", F.xxhash64("key", F.lit(depth), _block("blocks", depth)).alias("gid"))))
        roots = components(found).withColumnRenamed("node", "sid")
        labelled = written(wide.join(roots, "sid", "left").select("sid", "key", "n", F.coalesce("root", "sid").alias("label")), "labelled")
        one = written(labelled.groupBy("key", "label").agg(F.min(F.struct("sid", "n")).alias("one")).select("key", "one.sid", "one.n"), "one")
        apart = written(one.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1").select("key", _blocks(F.col("m"), F.col("s")).alias("blocks")), "apart")
        left = written(one.join(sized(apart, 24), "key").select("sid", "key", "blocks"), "left")
        now, depth = left.count(), depth + 1
        if not now:
            return found
        if 2 * now > rows:
            break
        rows = now
    members = written(labelled.join(sized(apart, 24), "key", "left_semi").select("sid", "n", "label").distinct(), "members")
    return found.unionByName(compared(_outside_to_all(_in_families(members, packed, shingle, similarity))))


def _packed_sets(docs: DataFrame, reps: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, packed): the text of one document of each set that ``sids`` names."""
    needed = written(reps.join(sids.select("sid").distinct(), "sid", "left_semi").select("sid", F.col("least.doc_id").alias("kept_id"), F.col("least.tag").alias("kept_tag")), "needed")
    on = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag"))
    return written(docs.join(sized(needed, 64), on).select("sid", "text").mapInArrow(_packed, "sid long, packed binary"), "packed")


def _comparer(packed: DataFrame, shingle: int, similarity: tuple[int, int]) -> Callable[[DataFrame], DataFrame]:
    """A function from (sid, gid) to the links (u, v) that connect similar sets of each gid."""

    def compared(dealt: DataFrame) -> DataFrame:
        together = dealt.join(packed, "sid").select("gid", "sid", "packed").repartition("gid").sortWithinPartitions("gid", "sid")
        return written(together.mapInArrow(_linked(shingle, similarity), "u long, v long"), "links")

    return compared


def fingerprint_links(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(u, v): verified links among the pairs that the SimHash index gives; reps (sid, fp, and its least document).

    The index gives no more pairs than connect all fingerprints within ``radius``
    bits, and sets of one fingerprint meet the first of them: so many pairs as sets.
    """
    first = written(reps.groupBy("fp").agg(F.min("sid").alias("u"), F.count("*").alias("sets")), "fingerprints")
    near = written(simhash.links(first.select("fp"), radius).distinct(), "near")
    ends = [sized(first.select(F.col("fp").alias(f"{c}_fp"), F.col("u").alias(c)), 24) for c in "ab"]
    pairs = near.withColumnsRenamed({"u": "a_fp", "v": "b_fp"}).join(ends[0], "a_fp").join(ends[1], "b_fp").select("a", "b")
    equal = reps.join(sized(written(first.where("sets > 1"), "shared"), 24), "fp").where("sid <> u").select(F.col("u").alias("a"), F.col("sid").alias("b"))
    pairs = written(pairs.unionByName(equal).select(F.explode(F.array("a", "b")).alias("sid"), F.xxhash64("a", "b").alias("gid")), "pairs")
    return _comparer(_packed_sets(docs, reps, pairs), shingle, similarity)(pairs)


def links(docs: DataFrame, reps: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, known: DataFrame | None = None) -> DataFrame:
    """(u, v): verified links that connect all sets which links connect; docs (doc_id, tag, text), reps (sid, n, bands, and its least document).

    ``known``: links found before. They are given back with the others, and keys whose sets they connect are not searched.
    """
    labelled = reps.select("sid", "n", "bands", F.col("sid").alias("label"))
    if known is not None:
        roots = written(components(known).withColumnRenamed("node", "sid"), "roots")
        labelled = reps.select("sid", "n", "bands").join(sized(roots, 16), "sid", "left").select("sid", "n", "bands", F.coalesce("root", "sid").alias("label"))
    rows = labelled.select("sid", "n", "label", F.explode("bands").alias("key"))
    stats = rows.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    shared = written(stats.select("key", _blocks(F.col("m"), F.col("shingles")).alias("blocks")), "keys")
    met = written(rows.join(sized(shared, 40), "key").select("sid", "key", "n", "blocks"), "met")
    packed = _packed_sets(docs, reps, met)
    compared = _comparer(packed, shingle, similarity)
    # a set of block b goes to all pairs of blocks that b is in
    narrow = met.where(F.col("blocks") <= NARROW_BLOCKS)
    pairs = narrow.select("sid", "key", _block("blocks").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    found = compared(pairs.select("sid", F.xxhash64("key", F.least("b", "j"), F.greatest("b", "j")).alias("gid")))
    found = found if known is None else known.unionByName(found)
    if shared.where(F.col("blocks") > NARROW_BLOCKS).isEmpty():
        return found
    return _wide_links(met.where(F.col("blocks") > NARROW_BLOCKS), found, packed, compared, shingle, similarity)


def near_deduplicated(docs: DataFrame, shingle: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The columns of ``docs``: of each component only the document of least id (of rows equal in id and text, one)."""
    plain, name = positional(docs)
    tagged = plain.withColumn("tag", F.xxhash64(name["text"])).withColumn("doc_id", F.col(name["doc_id"]).cast("long"))
    given = tagged.select("doc_id", "tag", F.col(name["text"]).alias("text"))
    sketches = written(given.mapInArrow(_sketches(shingle), "doc_id long, tag long, sid long, n int, fp long, bands array<long>"), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n", "fp", "bands")).alias("least")
    reps = sketches.groupBy("sid").agg(least, F.count("*").alias("rows"))
    reps = written(reps.select("sid", F.struct("least.none", "least.doc_id", "least.tag").alias("least"), "least.n", "least.fp", "least.bands", "rows"), "sets")
    known = fingerprint_links(given, reps, shingle, similarity)
    roots = components(links(given, reps, shingle, similarity, known)).withColumnRenamed("node", "sid")
    touched = written(reps.select("sid", "least", "rows").join(roots, "sid", "left").where("root is not null or rows > 1"), "touched")
    best = touched.where("root is not null").groupBy("root").agg(F.min("least").alias("best"))
    stays = touched.join(best, "root", "left").select("sid", F.coalesce("best", "least").alias("best"))
    rows = written(sketches.select("doc_id", "tag", "sid").join(stays, "sid"), "rows")
    stay = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag"))
    gone = written(rows.where(~stay).select(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct(), "gone")
    again = written(rows.where(stay).groupBy(F.col("doc_id").alias("gone_id"), F.col("tag").alias("gone_tag")).count().where("count > 1").drop("count"), "again")
    on = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("tag") == F.col("gone_tag"))
    left = tagged.join(sized(gone, 64), on, "left_anti")
    if not again.isEmpty():  # one of the rows that are equal in id and text
        rest = left.join(sized(again, 64), on, "left_semi").dropDuplicates(["doc_id", "tag"])
        left = left.join(sized(again, 64), on, "left_anti").unionByName(rest)
    return left.select(*plain.columns).toDF(*docs.columns)
