"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts by measured correlation, and each part i gets
a threshold t_i of its own (-1: not probed) with sum(t_i) = t - parts + 1: two
fingerprints within distance t are within t_i of each other in at least one
part. The thresholds are allocated by dynamic programming over estimated
candidate counts, and the number of parts by the total cost so found. Every
fingerprint is indexed by its value in each probed part and probes all values
within t_i of its own; what meets is verified on all 64 bits.

Only distinct fingerprints are searched, so exact copies cost nothing. In a
group of probes, a pair is compared only while its two sides are not yet known
to be connected, and one link for each newly connected component is emitted: a
large family of near copies gives links in proportion to its size. A group of
more than ``GROUP_ROWS`` rows is dealt again by its value and one of threshold
+ 1 pieces of the other bits, of which near fingerprints share at least one.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; a null doc_id never names a component unless the component has no id.
Rows that repeat an id each get a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import positional, sized, table, written
from pairforge.llm.graph import components

BITS = 64
SEED = 42
#: Hashes whose bits are counted at once.
VOTES = 1 << 16
#: Cost of one probe row against one compared pair, for choosing thresholds.
PROBE_COST = 100.0
#: Rows of a group from which comparisons skip pairs that are already connected.
LARGE_GROUP = 64
#: Rows of a group from which it is split over tasks by further bits.
GROUP_ROWS = 50_000
_PROBED = "part byte, value long, probe boolean, fp long"


def majority(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The fingerprint of each row of hashes, rows being cut at ``cut``: the bits that more than half of them have."""
    count = np.diff(cut)
    votes = np.zeros((len(count), BITS), np.int32)
    for at in range(0, len(h), VOTES):  # a row may go on in the next block
        bits = np.unpackbits(h[at : at + VOTES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(cut, at, "right") - 1
        own = first + np.flatnonzero(count[first : np.searchsorted(cut, at + len(bits))])
        votes[own] += np.add.reduceat(bits, np.maximum(cut[own] - at, 0), axis=0, dtype=np.int32)
    return np.packbits(votes * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                data, offsets = K.flat(batch.column("text"))
                data = K.LOWER[data]
                starts, ends, rows = K.spans(data, offsets, K.NOT_SPACE)
                text, at = K.joined(data, starts, ends)
                words = np.diff(rows)
                count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
                first, cut = K.ragged(rows[:-1], count)
                size = np.repeat(np.minimum(words, shingle), count)
                raw, digest = text.tobytes(), xxhash.xxh64_intdigest
                h = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[first].tolist(), (at[first + size] - 1).tolist(), strict=True)), np.uint64, len(first))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("tag"), pa.array(majority(h, cut).view(np.int64))], names=["doc_id", "tag", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, tag, fp long): a bit is set if it is in more than half of the shingles' XXH64; tag: a hash of the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("tag"), "text").mapInArrow(_fingerprints(shingle), "doc_id long, tag long, fp long")


def _unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _cooccurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    n = 0
    for batch in batches:
        x = _unpacked(batch.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
        for i in range(0, len(x), 100_000):  # sums stay exact in float32
            both += x[i : i + 100_000].T @ x[i : i + 100_000]
        n += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BITS * BITS)), pa.array(np.append(n, both.ravel()).astype(np.int64))], names=["cell", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and for each pair of bits how many have both set."""
    cells = dict(distinct.select("fp").mapInArrow(_cooccurrence, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of equal width or one less; correlated bits go together, greedily."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    close = np.abs(np.divide(both / max(n, 1) - np.outer(p, p), spread, out=np.zeros_like(both), where=spread > 0))
    left, out = list(range(BITS)), []
    for i in range(parts):
        width = (BITS + i) // parts
        sub = close[np.ix_(left, left)] - 2 * np.eye(len(left))
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(max(rest, key=lambda b: (close[b, group].mean(), -b)))
        out.append(sorted(group))
        left = [b for b in left if b not in group]
    return out


def estimated_pairs(n: int, both: np.ndarray, group: list[int], most: int) -> list[float]:
    """For thresholds 0 to ``most``: pairs expected within that distance in ``group``, from how often each bit differs."""
    p = np.diag(both)[group] / max(n, 1)
    at = np.zeros(most + 1)
    at[0] = 1.0
    for q in 2 * p * (1 - p):
        at[1:] = at[1:] * (1 - q) + at[:-1] * q
        at[0] *= 1 - q
    return list(np.cumsum(at) * n * n / 2)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, one for each part, of sum ``total`` and least cost; costs[i][t + 1] is that of t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (cost, chosen) in best.items():
            for i, own in enumerate(options):
                key = have + i - 1
                if key not in step or cost + own < step[key][0]:
                    step[key] = (cost + own, [*chosen, i - 1])
        best = step
    return best[total]


def plan(n: int, both: np.ndarray, threshold: int, most_parts: int = 6) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each probed part."""
    found = None
    for parts in range(2, most_parts + 1):
        groups = group_bits(n, both, parts)
        costs = []
        for g in groups:
            pairs = estimated_pairs(n, both, g, threshold)
            costs.append([0.0, *(PROBE_COST * n * sum(comb(len(g), k) for k in range(t + 1)) + pairs[t] for t in range(threshold + 1))])
        cost, chosen = allocate(costs, threshold - parts + 1)
        if found is None or cost < found[0]:
            found = cost, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]
    return found[1]


def _probes(parts: list[tuple[list[int], int]]):
    masks = []
    for bits, t in parts:
        flips = [sum(1 << b for b in c) for k in range(t + 1) for c in combinations(bits, k)]
        masks.append((np.uint64(sum(1 << b for b in bits)), np.array(flips, np.uint64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                fp = whole.slice(at, 4096).column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                for i, (mask, flips) in enumerate(masks):
                    value = ((fp & mask)[:, None] ^ flips[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), i, np.int8)), pa.array(value.view(np.int64)), pa.array(np.tile(np.arange(len(flips)) > 0, len(fp))), pa.array(np.repeat(fp, len(flips)).view(np.int64))],
                        names=["part", "value", "probe", "fp"],
                    )

    return run


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _large(fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all that is connected within one large group: each round compares one row with those not yet in its component."""
    fp = np.unique(fp)
    label = np.arange(len(fp))
    for x in range(len(fp)):
        other = np.flatnonzero(label != label[x])
        if not len(other):
            return
        hit = other[_distance(fp[other], fp[x]) <= threshold]
        if len(hit):
            merged, one = np.unique(label[hit], return_index=True)
            label[np.isin(label, merged)] = label[x]
            yield np.full(len(one), fp[x]), fp[hit[one]]


def _verified(part: np.ndarray, value: np.ndarray, probe: np.ndarray, fp: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within the groups of sorted rows; a group's indexed rows come before its probes."""
    new = np.append(True, (value[1:] != value[:-1]) | (part[1:] != part[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(fp)))
    indexed = np.add.reduceat((~probe).astype(np.int64), first)
    for g in np.flatnonzero((size > LARGE_GROUP) & (indexed > 0)):
        yield from _large(fp[first[g] : first[g] + size[g]], threshold)
    small = np.flatnonzero((size > 1) & (size <= LARGE_GROUP) & (indexed > 0))
    if not len(small):
        return
    row, cut = K.ragged(first[small], size[small])
    place = np.arange(len(row)) - np.repeat(cut[:-1], size[small])
    against = np.minimum(place, np.repeat(indexed[small], size[small]))  # indexed rows before this one
    for i in range(0, len(row), 100_000):
        own = slice(i, i + 100_000)
        other, _ = K.ragged((row - place)[own], against[own])
        a, b = fp[np.repeat(row[own], against[own])], fp[other]
        near = (_distance(a, b) <= threshold) & (a != b)
        if near.any():
            yield a[near], b[near]


def _links(threshold: int):
    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "probe", "fp"))
            held.append(now)
            if now[1][0] == now[1][-1] and now[0][0] == now[0][-1]:
                continue  # perhaps all of one group, which may go on
            part, value, probe, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((value != value[-1]) | (part != part[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut and (found := list(_verified(part[:cut], value[:cut], probe[:cut], fp[:cut].view(np.uint64), threshold))):
                yield out(found)
            held = [(part[cut:], value[cut:], probe[cut:], fp[cut:])]
        if held:
            part, value, probe, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            if found := list(_verified(part, value, probe, fp.view(np.uint64), threshold)):
                yield out(found)

    return run


def _finer(parts: list[tuple[list[int], int]], threshold: int):
    """Rows of large groups under finer keys: the value, with the fingerprint's bits in each piece of what is outside the part."""
    pieces = threshold + 1
    rest = [[b for b in range(BITS) if b not in bits] for bits, _ in parts]
    masks = np.array([[sum(1 << b for b in own[j::pieces]) for j in range(pieces)] for own in rest], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "fp"))
            for j in range(pieces):
                key = value.view(np.uint64) | fp.view(np.uint64) & masks[part, j]
                yield pa.RecordBatch.from_arrays([pa.array(part * np.int8(pieces) + np.int8(j)), pa.array(key.view(np.int64)), batch.column("probe"), batch.column("fp")], names=["part", "value", "probe", "fp"])

    return run


def links(distinct: DataFrame, threshold: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v): verified links that connect every two fingerprints which chains of links connect."""

    def compared(probes: DataFrame) -> DataFrame:
        return probes.repartition("part", "value").sortWithinPartitions("part", "value", "probe").mapInArrow(_links(threshold), "u long, v long")

    parts = plan(*bit_statistics(distinct), threshold)
    probes = distinct.select("fp").mapInArrow(_probes(parts), _PROBED)
    large = written(probes.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("part", "value"), "groups")
    if large.isEmpty():
        return compared(probes)
    side = sized(large, 16)
    split = probes.join(side, ["part", "value"], "left_semi").mapInArrow(_finer(parts, threshold), _PROBED)
    # finer keys get part numbers of their own, beyond those of the parts
    split = split.withColumn("part", (F.col("part") + len(parts)).cast("byte"))
    return compared(probes.join(side, ["part", "value"], "left_anti").unionByName(split))


def simhash_components(docs: DataFrame, shingle: int = 4, threshold: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, tag, fp, component_id, keep_tag), a row for each document; component_id is the smallest doc_id reachable over links.

    keep_tag is the tag of the row that names the component; ``group_rows`` bounds
    the groups compared at once and changes no result.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag"))
    fps = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(least.alias("least")), "distinct")
    roots = components(links(distinct, threshold, group_rows)).withColumnRenamed("node", "fp")
    known = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.doc_id").alias("component_id"), F.col("least.tag").alias("keep_tag")), "root").select("fp", "component_id", "keep_tag")
    return fps.join(written(named, "named"), "fp")


def near_deduplicated(docs: DataFrame, shingle: int = 4, threshold: int = 4) -> DataFrame:
    """The columns of ``docs``: of each component only the document that names it (of rows equal in id and text, one)."""
    plain, name = positional(docs)
    tagged = plain.withColumn("tag", F.xxhash64(name["text"])).withColumn("doc_id", F.col(name["doc_id"]).cast("long"))
    rows = written(simhash_components(tagged.select("doc_id", F.col(name["text"]).alias("text")), shingle, threshold).select("doc_id", "tag", "component_id", "keep_tag"), "rows")
    stays = F.expr("doc_id <=> component_id and tag = keep_tag")
    kept = written(rows.where(stays).groupBy(F.col("doc_id").alias("kept_id"), F.col("tag").alias("kept_tag")).agg(F.count("*").alias("times")), "kept")
    left = tagged.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("tag") == F.col("kept_tag")))
    out = left.where("times = 1").unionByName(left.where("times > 1").dropDuplicates(["doc_id", "tag"]))
    return out.select(*plain.columns).toDF(*docs.columns)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
