"""How filters overlap: what each removes first, again, alone and on average over all orders.

Five filters look at whole texts: too few words (A), too few distinct words (B),
too many capitals (C), certain characters (D), a text that a smaller doc_id has
too (E). A document's failures are a mask of five bits; every count asked for is
a sum over the documents' masks, so the corpus is reduced to a count of each mask
by part and label before any order of filters is looked at.

E needs equal texts to meet. Equal texts of a slice are one record first. Records
are range-partitioned by adaptive prefixes: seven bytes of the text, and where
many texts share them, the seven bytes that follow what all those texts share,
and so on. In a range, sorted texts go into a compressed radix trie whose
terminals hold the least id and the records of that text; traversing it tells the
records of repeated texts their least id. Since texts come sorted, all but the
last text's path can be traversed and released whenever a trie has grown to
``TRIE_BYTES``, so a range of any size takes bounded memory.

Defined cases: a null text counts as empty, a null source as the part ''; of rows
that repeat a doc_id and text neither is smaller than the other; a null doc_id is
neither smaller nor larger than any; an id that ``labels`` repeats has a label if
any of its rows has it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import partitions, sized, table, written

FILTERS = "ABCDE"
_BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
#: Bytes of a prefix that ranges are cut by at one level, and the most levels.
_LEAD, _LEVELS = 7, 6
#: Bytes in which texts of a heavy prefix are compared at a level.
_PIECE = 1 << 16
#: Text that a trie holds before what is finished is released.
TRIE_BYTES = 32 << 20
_MARKS = np.zeros(256, bool)
_MARKS[list(b"#$%&*|")] = True


# --- filters of one text ---


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    run = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return run[offsets[1:]] - run[offsets[:-1]]


def text_masks(texts: pa.Array) -> np.ndarray:
    """The bits of A to D of each text."""
    data, offsets = K.flat(texts)
    starts, ends, rows = K.spans(data, offsets, K.NOT_SPACE)
    words = np.diff(rows)
    distinct = np.zeros(len(words), np.int64)
    if len(starts):
        blocks = []  # of about a slice of bytes each
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + K.SLICE_BYTES, "right")))
            blocks.append(K.gather(data, starts[lo:hi], ends[lo:hi]))
            lo = hi
        coded = pa.chunked_array(blocks).dictionary_encode()
        code = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
        n = int(code.max()) + 1
        distinct += np.bincount(np.unique(np.repeat(np.arange(len(words)), words) * n + code) // n, minlength=len(words))
    points = _per_row((data & 0xC0) != 0x80, offsets)
    capitals = _per_row((data >= 0x41) & (data <= 0x5A), offsets)
    marks = _per_row(_MARKS[data], offsets)
    return (words < 50) * _BIT["A"] + (100 * distinct < 65 * words) * _BIT["B"] + (100 * capitals > 5 * points) * _BIT["C"] + (marks > 0) * _BIT["D"]


_ROWS = "tag long, doc_id long, part string, mask int, own_min long, text binary, lead long"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document. Equal texts of a slice share a tag, and the first of them carries the text and the least id of them."""
    tag = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
    for whole in batches:
        for batch in K.slices(whole, "text", 4 * K.SLICE_BYTES):
            given = batch.column("text").cast(pa.binary()).fill_null(b"")
            texts = given.cast(pa.large_binary())
            mask = text_masks(texts)
            coded = texts.dictionary_encode()
            code, n = coded.indices.to_numpy(), len(coded.dictionary)
            first = np.full(n, len(code), np.int64)
            np.minimum.at(first, code, np.arange(len(code)))
            ids = batch.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            least, has = np.full(n, (1 << 63) - 1, np.int64), np.zeros(n, bool)
            np.minimum.at(least, code, ids)
            has[code[known]] = True
            carries = np.zeros(len(code), bool)
            carries[first] = True
            lead = [int.from_bytes(t[:_LEAD].ljust(_LEAD, b"\0"), "big") for t in coded.dictionary.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(code.astype(np.int64) + tag), batch.column("doc_id"), batch.column("part"), pa.array(mask.astype(np.int32)), pa.array(least[code], mask=~has[code]),
                    given.take(pa.array(np.arange(len(code)), mask=~carries)), pa.array(np.array(lead, np.int64)[code]),
                ],
                names=["tag", "doc_id", "part", "mask", "own_min", "text", "lead"],
            )
            tag += n


# --- adaptive prefixes ---


def _code(text: Column, at: Column) -> Column:
    """Seven bytes of a text from ``at`` on as a number in their order."""
    return F.conv(F.hex(F.rpad(F.substring(text, at + 1, F.lit(_LEAD)), _LEAD, F.lit(b"\0"))), 16, 10).cast("long")


def _shared(low: bytes, high: bytes) -> int:
    """Length of what two texts begin with alike."""
    n = min(len(low), len(high))
    unlike = np.flatnonzero(np.frombuffer(low, np.uint8, n) != np.frombuffer(high, np.uint8, n))
    return int(unlike[0]) if len(unlike) else n


class Prefixes:
    """The heavy prefixes of each level: (node, code) with the node below it, and where the texts below go on after what they share."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.start: dict[int, int] = {}  # where texts go on below each node of the last level

    def add(self, rows: list[tuple[int, int, int, int]]) -> None:
        """A level of rows (node, code, child, next)."""
        node, code, child, after = np.array(sorted(rows), np.int64).reshape(-1, 4).T
        self.levels.append((np.unique(code), node, code, child, after))
        self.start = dict(zip(child.tolist(), after.tolist(), strict=True))

    def with_level(self, rows: list[tuple[int, int, int, int]]) -> Prefixes:
        out = Prefixes()
        out.levels = list(self.levels)
        out.add(rows)
        return out

    def descend(self, texts: pa.Array, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The node that each text ends in (-1: above the last level), where it goes on there, and its codes."""
        data, offsets = K.flat(texts)
        node, at, codes = np.zeros(len(lead), np.int64), np.zeros(len(lead), np.int64), [lead]
        for distinct, nodes, own, child, after in self.levels:
            place = np.searchsorted(distinct, codes[-1])
            known = (node >= 0) & (place < len(distinct))
            known[known] = distinct[place[known]] == codes[-1][known]
            pairs = nodes * len(distinct) + np.searchsorted(distinct, own)  # in the order of the rows
            pair = node * len(distinct) + place
            row = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            known[known] = pairs[row[known]] == pair[known]
            node = np.where(known, child[row], -1)
            at = np.where(known, after[row], at)
            code, inside = np.zeros(len(lead), np.int64), np.flatnonzero(known)
            for i in range(_LEAD):
                place = offsets[:-1][inside] + at[inside] + i
                there = place < offsets[1:][inside]
                byte = np.zeros(len(inside), np.int64)
                byte[there] = data[place[there]]
                code[inside] = code[inside] << 8 | byte
            codes.append(code)
        return node, at, codes


def _weights(prefixes: Prefixes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                node, _, codes = prefixes.descend(batch.column("text"), batch.column("lead").to_numpy())
                size = np.diff(K.flat(batch.column("text"))[1]) + 16
                yield pa.RecordBatch.from_arrays([pa.array(x[node >= 0]) for x in (node, codes[-1], size)], names=["node", "code", "bytes"])

    return run


def _ends(prefixes: Prefixes):
    """Of each slice and node the least and the greatest of what its texts go on with, up to a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                texts = batch.column("text")
                node, at, _ = prefixes.descend(texts, batch.column("lead").to_numpy())
                ends: dict[int, tuple[int, bytes, bytes]] = {}
                for i in np.flatnonzero(node >= 0).tolist():
                    piece = texts[i].as_py()[at[i] : at[i] + _PIECE]
                    _, low, high = ends.get(int(node[i]), (0, piece, piece))
                    ends[int(node[i])] = int(at[i]), min(low, piece), max(high, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(ends), pa.int64()), *(pa.array([e[k] for e in ends.values()], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary())))],
                    names=["child", "at", "low", "high"],
                )

    return run


def _going_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(child, next) of the nodes whose texts are not all equal from where they stand on: where they go on after what they share."""
    for batch in batches:
        child, after = [], []
        for r in batch.to_pylist():
            shared = _shared(r["low"], r["high"])
            if r["low"] != r["high"] or shared == _PIECE:
                child.append(r["child"])
                after.append(r["at"] + shared)
        yield pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(after, pa.int64())], names=["child", "next"])


def _keyed(prefixes: Prefixes, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                codes = prefixes.descend(batch.column("text"), batch.column("lead").to_numpy())[2]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *map(pa.array, codes)], names=[*columns, *(f"k{i}" for i in range(len(codes)))])

    return run


def with_prefix_keys(records: DataFrame, n: int) -> tuple[DataFrame, list[str]]:
    """``records`` with columns of prefix codes that sort as the texts do, as many levels as heavy prefixes need.

    A prefix is heavy if its records hold more than half of an n-th of all bytes,
    so there are fewer than 2n of them at a level, however large the table is.
    Tasks hold the heavy prefixes and look each record's up, in one pass a step
    over the records below heavy first codes; no level repeats those before it.
    """
    weight = records.groupBy("lead").agg(F.sum(F.length("text") + 16).alias("bytes"), F.count("*").alias("rows"))
    total = records.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    is_heavy = (F.col("bytes") > total / (2 * n)) & (F.col("rows") > 1)
    found = [(0, r["lead"]) for r in weight.where(is_heavy).collect()]
    prefixes, below = Prefixes(), F.col("lead").isin([code for _, code in found])
    deep = records.where(below)
    for _ in range(1, _LEVELS):
        if not found:
            break
        # texts go on from where their node stands until it is known what they share
        tried = prefixes.with_level([(*f, i, prefixes.start.get(f[0], 0)) for i, f in enumerate(found)])
        ends = deep.select("text", "lead").mapInArrow(_ends(tried), "child long, at long, low binary, high binary")
        ends = ends.groupBy("child").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.first("at").alias("at"))
        going_on = ends.mapInArrow(_going_on, "child long, next long").collect()  # a row of two numbers for each heavy prefix
        nodes = [(*found[r["child"]], i, r["next"]) for i, r in enumerate(sorted(going_on))]
        if not nodes:
            break
        prefixes.add(nodes)
        weight = deep.select("text", "lead").mapInArrow(_weights(prefixes), "node long, code long, bytes long").groupBy("node", "code").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows"))
        found = [(r["node"], r["code"]) for r in weight.where(is_heavy).collect()]
    keys = [f"k{i}" for i in range(len(prefixes.levels) + 1)]
    light = records.withColumns({k: F.lit(0).cast("long") if i else F.col("lead") for i, k in enumerate(keys)})
    if len(keys) == 1:
        return light, keys
    kinds = ", ".join([*(f"{c} {kind}" for c, kind in records.dtypes), *(f"{k} long" for k in keys)])
    return light.where(~below).unionByName(deep.mapInArrow(_keyed(prefixes, records.columns), kinds)), keys


# --- tries ---


class _Node:
    __slots__ = ("edge", "below", "least", "tags", "told")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.below = edge, {}
        self.least: int | None = None
        self.tags: array | None = None  # a terminal has one
        self.told = False  # whether records of this text were told its least id before


class RadixTrie:
    """Whole texts on compressed edges; a terminal holds the least id of its text and the tags of its records."""

    def __init__(self) -> None:
        self.root, self.held = _Node(b""), 0

    def insert(self, text: bytes) -> _Node:
        """The terminal of ``text``, made if there is none."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is None:
                child = node.below[text[at]] = _Node(text[at:])
                self.held += len(text) - at + 200
                at = len(text)
            elif text.startswith(child.edge, at):
                at += len(child.edge)
            else:  # the edge is cut where the texts part
                k = _shared(child.edge, text[at : at + len(child.edge)])
                upper = _Node(child.edge[:k])
                node.below[text[at]] = upper
                child.edge = child.edge[k:]
                upper.below[child.edge[0]] = child
                self.held += 200
                child, at = upper, at + k
            node = child
        if node.tags is None:
            node.tags = array("q")
        return node

    def add(self, text: bytes, tag: int, least: int | None) -> _Node:
        node = self.insert(text)
        node.tags.append(tag)
        self.held += 8
        if least is not None and (node.least is None or least < node.least):
            node.least = least
        return node

    def terminals(self) -> Iterator[_Node]:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node.tags is not None:
                yield node
            stack.extend(node.below.values())


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tag, least) of the records whose text has other records, too; records come sorted by text, and of one text by least id."""
    trie, last, node = RadixTrie(), b"", None

    def out(trie: RadixTrie) -> pa.RecordBatch:
        tags, least = array("q"), []
        for t in trie.terminals():
            if t.least is not None and (len(t.tags) > 1 or t.told):
                tags.extend(t.tags)
                least += [t.least] * len(t.tags)
        return pa.RecordBatch.from_arrays([pa.array(np.array(tags, np.int64)), pa.array(least, pa.int64())], names=["tag", "least"])

    for batch in batches:
        for tag, text, least in zip(batch.column("tag").to_pylist(), batch.column("text"), batch.column("own_min").to_pylist(), strict=True):
            if trie.held > TRIE_BYTES:
                # all other texts are finished; of this one the least id is known, as it came first
                done, trie = trie, RadixTrie()
                before, node = node, trie.insert(last)
                node.least, node.told = before.least, before.told or len(before.tags) > 1
                if not node.told:
                    node.tags.extend(before.tags)
                yield out(done)
            last = text.as_py()
            node = trie.add(last, tag, least)
    yield out(trie)


def least_ids(records: DataFrame) -> DataFrame:
    """(tag, least) for the records (tag, text, own_min, lead) of texts that have several: the least id of all rows with that text."""
    n = partitions(records.sparkSession)
    keyed, keys = with_prefix_keys(records, n)
    ranged = keyed.select("tag", "text", "own_min", *keys).repartitionByRange(n, *keys).sortWithinPartitions("text", F.col("own_min").asc_nulls_last())
    return ranged.select("tag", "text", "own_min").mapInArrow(_least_ids, "tag long, least long")


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask): a row for each document, with the bits of the filters that it fails."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    rows = written(given.mapInArrow(_records, _ROWS), "records")
    told = written(least_ids(rows.where(F.col("text").isNotNull()).select("tag", "text", "own_min", "lead")), "least")
    later = F.coalesce(F.col("doc_id") > F.coalesce("least", "own_min"), F.lit(False))
    marked = rows.select("tag", "doc_id", "part", "mask", "own_min").join(sized(told, 24), "tag", "left")
    return marked.select("doc_id", "part", F.when(later, F.col("mask") + _BIT["E"]).otherwise(F.col("mask")).alias("mask"))


# --- orders ---


def _orders(spark) -> DataFrame:
    """(filter_order, step, bit, before): the steps of all orders, and the bits of the filters before."""
    rows = [(o := "".join(p), i + 1, _BIT[o[i]], sum(_BIT[f] for f in o[:i])) for p in itertools.permutations(FILTERS) for i in range(len(p))]
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each part, order of filters and step."""
    spark = docs.sparkSession
    good, toxic = (F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic")))
    known = written(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good, toxic), "labels")
    # rows that share id, part and mask are one before ids meet their labels, so no id is hot
    cells = failures(docs).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n")).join(sized(known.where("good OR toxic"), 24), "doc_id", "left")
    cells = cells.groupBy("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))
    steps = [(b, e) for b in _BIT.values() for e in range(32) if not b & e]
    bit, before = F.col("s.bit"), F.col("s.before")
    fails, out = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(before) != 0
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    by_step = (
        cells.withColumn("s", F.explode(F.array(*(F.struct(F.lit(b).alias("bit"), F.lit(e).alias("before")) for b, e in steps))))
        .groupBy("part", bit.alias("bit"), before.alias("before"))
        .agg(
            n(~fails & ~out).alias("kept"),
            n(fails & ~out).alias("removed"),
            n(fails & out).alias("redundant"),
            n(F.col("mask") == bit).alias("unique_fails"),
            n(fails & ~out & F.col("good")).alias("good_lost"),
            n(fails & ~out & F.col("toxic")).alias("toxic_lost"),
            # of all 120 orders, the filter is the first that the document fails in one of as many as it fails
            F.sum(F.when(fails, F.col("n") * 120 / F.bit_count("mask")).otherwise(0)).cast("long").alias("shapley"),
        )
    )
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return by_step.join(F.broadcast(_orders(spark)), ["bit", "before"]).select("part", "filter_order", "step", *counts)  # 600 rows


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT doc_id, part,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit <> b.bit AND a.bit <> c.bit AND a.bit <> d.bit AND b.bit <> c.bit AND b.bit <> d.bit AND c.bit <> d.bit
    AND e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
s AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, bits[i] AS bit, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INTEGER) AS before
  FROM o, range(1, 6) r(i)),
x AS (
  SELECT part, filter_order, step, n, good, toxic, mask, bit, (mask & bit) <> 0 AS fails, (mask & before) <> 0 AS gone FROM cells, s),
y AS (
  SELECT part, filter_order, step, any_value(bit) AS bit,
         CAST(sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN fails AND NOT gone AND good = 1 THEN n ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN fails AND NOT gone AND toxic = 1 THEN n ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM x GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM y
"""
