"""Token ids of a corpus in checksummed, independently coded blocks.

Documents are range-partitioned and sorted by doc_id (null last, ties by a hash
of the text), tokenised, given an end id each, and coded in blocks of about
``BLOCK_IDS`` ids by the range coder of ``coder``. A file is a Parquet file of
blocks: part, block, the documents' ids and lengths, and the coded bytes.

The tokenizer always cuts before a space between two characters that are not
white space, between an ASCII letter and any other ASCII character, and after a
line feed that stands alone before a letter (so do all byte-level tokenizers with
the usual pattern). Texts are cut there, and each distinct piece is encoded once
(the most frequent of earlier slices are remembered, up to a bound). Texts with a
special token or with white space beyond ASCII are encoded whole, and so are all
texts with another kind of tokenizer.

Defined cases: null or empty text is the end id alone; rows that repeat a doc_id
each count; an empty table gives no blocks.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm import coder
from pairforge.llm import kernel as K
from pairforge.llm.common import partitions, shared_dir, table, written

BLOCK_IDS = coder.LANES * coder.STEPS
END_ID = 0
#: Pieces that a worker remembers; beyond it keeps the half that it meets most.
REMEMBERED = 200_000
#: White space beyond ASCII, and control characters that some libraries take for it.
_WIDE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Kinds of bytes, as bits of one table.
_WHITE, _DENSE, _LETTER, _SPACE, _MARK, _FEED, _AFTER = (1 << i for i in range(7))


def _kinds() -> bytes:
    out = []
    for b in range(256):
        white, letter = bool(K.SPACE[b]), 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
        mark = b < 0x80 and not letter and b != 0x20  # ASCII that a letter's piece ends before
        bits = (white, not white, letter, b == 0x20, mark, b == 0x0A, letter or b >= 0x80)
        out.append(sum(bit << i for i, bit in enumerate(bits)))
    return bytes(out)


_KINDS = _kinds()


def _cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted places where pieces begin: rows' own, and those at which the tokenizer cuts whatever stands around."""
    n = len(data)
    cut = np.zeros(n + 1, np.uint8)
    if n > 2:
        kind = np.frombuffer(data.tobytes().translate(_KINDS), np.uint8)
        has = lambda bit, at: (kind[at] & bit) != 0
        cut[1 : n - 1] = has(_SPACE, slice(1, n - 1)) & has(_DENSE, slice(n - 2)) & has(_DENSE, slice(2, n))
        cut[1:n] |= has(_LETTER, slice(n - 1)) & has(_MARK, slice(1, n))
        cut[2:n] |= has(_FEED, slice(1, n - 1)) & has(_DENSE, slice(n - 2)) & has(_AFTER, slice(2, n))
    # what stands in another row doesn't count
    edges = offsets[(offsets > 0) & (offsets < n)]
    for d in (-1, 1):
        near = edges + d
        cut[near[(near > 0) & (near < n)]] = 0
    cut[offsets] = 1
    return np.flatnonzero(cut.view(bool))


_TAKEN = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)  # the first i bytes of a word
#: Bytes of the longest piece that is remembered: with its length it fills three words of 8 bytes.
_LONGEST = 23


def _keys(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three words that spell each piece of up to 23 bytes and its length, exactly, and a hash of them."""
    size = np.diff(begin)
    padded = np.concatenate([data, np.zeros(24, np.uint8)])
    words = np.ndarray((len(data) + 17,), "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    key = np.empty((3, len(size)), np.uint64)
    key[0] = words[begin[:-1]] & _TAKEN[np.minimum(size, 8)]
    for i in (1, 2):
        some = np.flatnonzero(size > 8 * i)
        key[i] = 0
        key[i, some] = words[begin[some] + 8 * i] & _TAKEN[np.minimum(size[some] - 8 * i, 8)]
    key[2] |= size.astype(np.uint64) << np.uint64(56)
    return key, K.mix(key[0] ^ K.mix(key[1] + key[2] * np.uint64(0x9E3779B97F4A7C15)))


class Pieces:
    """The pieces a worker knows: an open-addressed table from their exact spelling to the place of their ids."""

    def __init__(self, bits: int = 16) -> None:
        n = 1 << bits - 1
        self.n, self.used = 0, 0
        self.table = np.full(1 << bits, -1, np.int32)
        self.key, self.hash = np.zeros((3, n), np.uint64), np.zeros(n, np.uint64)
        self.at, self.length, self.met = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32)

    def __len__(self) -> int:
        return self.n

    def find(self, key: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The slot of each key, or -1."""
        out, last = np.full(len(h), -1, np.int64), len(self.table) - 1
        left, place = np.arange(len(h)), (h & np.uint64(last)).astype(np.int64)
        while len(left):
            slot = self.table[place]
            some = slot >= 0
            left, place, slot = left[some], place[some], slot[some]
            same = (self.hash[slot] == h[left]) & (self.key[:, slot] == key[:, left]).all(axis=0)
            out[left[same]] = slot[same]
            left, place = left[~same], (place[~same] + 1) & last
        return out

    def _enter(self, slot: np.ndarray) -> None:
        last = len(self.table) - 1
        place = (self.hash[slot] & np.uint64(last)).astype(np.int64)
        while len(slot):
            free = self.table[place] < 0
            self.table[place[free]] = slot[free]
            lost = self.table[place] != slot  # taken before, or by another just now
            slot, place = slot[lost], (place[lost] + 1) & last

    def add(self, key: np.ndarray, h: np.ndarray, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Slots of new, distinct keys with their ids in a row."""
        slot = np.arange(self.n, self.n + len(h))
        while self.n + len(h) > len(self.hash):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)], axis=1)
            self.hash, self.at, self.length, self.met = (np.append(x, np.zeros_like(x)) for x in (self.hash, self.at, self.length, self.met))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.key[:, slot], self.hash[slot], self.length[slot] = key, h, length
        self.at[slot] = self.used + np.cumsum(length) - length
        self.n, self.used = self.n + len(h), self.used + len(ids)
        if 2 * self.n > len(self.table):
            self.table = np.full(1 << (4 * self.n - 1).bit_length(), -1, np.int32)
            slot = np.arange(self.n)
        self._enter(slot)
        return np.arange(self.n - len(h), self.n)

    def half(self) -> Pieces:
        """The half of the pieces that were met in the most slices, of late above all."""
        keep = np.sort(np.argsort(-self.met[: self.n], kind="stable")[: self.n // 2])
        out = Pieces()
        index, _ = K.ragged(self.at[keep], self.length[keep].astype(np.int64))
        out.add(self.key[:, keep], self.hash[keep], self.ids[index], self.length[keep])
        out.met[: out.n] = self.met[keep] // 2
        return out


class PieceTokenizer:
    """The ids of whole texts by a tokenizers file, piece by piece."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.odd = "|".join([_WIDE, *(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())])
        parts = json.loads(self.tokenizer.to_str())
        cutter = parts["pre_tokenizer"] or {}
        self.cuttable = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not parts["normalizer"]
        self.feed = self.plain(["\n"])[0][0] if self.cuttable else -1
        #: Ids whose bytes begin with a space, which byte-level vocabularies write as U+0120.
        self.led = np.zeros(self.size, bool)
        self.led[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("\u0120")]] = True
        self.known = Pieces()

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def looked_up(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place of each piece's ids among them, and how many): each distinct piece is encoded once."""
        if len(self.known) > REMEMBERED:
            self.known = self.known.half()
        size = np.diff(begin)
        short = np.flatnonzero(size <= _LONGEST) if size.max(initial=0) > _LONGEST else slice(None)
        key, h = _keys(data, begin)
        key, h = (key, h) if isinstance(short, slice) else (key[:, short], h[short])
        coded = pa.array(h).dictionary_encode()
        which, one = coded.indices.to_numpy(), np.empty(len(coded.dictionary), np.int64)
        one[which] = np.arange(len(which))
        if any(not np.array_equal(k[one][which], k) for k in key):  # two spellings share a hash
            one, which = np.unique(key, axis=1, return_index=True, return_inverse=True)[1:]
            which = which.ravel()
        own, hashed = key[:, one], h[one]
        slot = self.known.find(own, hashed)
        new = np.flatnonzero(slot < 0)
        if len(new):
            at = one[new] if isinstance(short, slice) else short[one[new]]
            slot[new] = self.known.add(own[:, new], hashed[new], *self.distinct(K.gather(data, begin[at], begin[at + 1])))
        self.known.met[slot] += 1
        known = self.known
        if isinstance(short, slice):
            return known.ids, known.at[slot][which], known.length[slot][which].astype(np.int64)
        place, n = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        place[short], n[short] = known.at[slot][which], known.length[slot][which]
        long = np.flatnonzero(size > _LONGEST)  # too rare to be remembered
        coded = K.gather(data, begin[long], begin[long + 1]).dictionary_encode()
        ids, length = self.distinct(coded.dictionary)
        which = coded.indices.to_numpy()
        place[long], n[long] = (known.used + np.cumsum(length) - length)[which], length[which]
        return np.concatenate([known.ids[: known.used], ids]), place, n

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has. Pieces whose one white space is a space in front are encoded as one text, others in a text with a line each."""
        data, offsets = K.flat(pieces)
        blank = np.concatenate(([0], np.cumsum(K.SPACE[data])))
        size = np.diff(offsets)
        spaced = (size > 1) & (blank[offsets[1:]] - blank[offsets[:-1]] == 1)
        spaced[spaced] = data[offsets[:-1][spaced]] == 0x20
        own = pieces.filter(pa.array(spaced))
        ids = np.array(self.plain([K.flat(own)[0].tobytes().decode()])[0] if len(own) else [], np.uint32)
        starts = np.flatnonzero(self.led[ids])
        if len(starts) != len(own) or (len(own) and starts[0]):
            raise ValueError("the tokenizer does not cut before a space")
        rest, rest_size = self._lines(pieces.filter(pa.array(~spaced)).to_pylist())
        n = np.zeros(len(pieces), np.int64)
        n[spaced], n[~spaced] = np.diff(starts, append=len(ids)), rest_size
        out = np.zeros(int(n.sum()), np.uint32)
        begin = np.cumsum(n) - n
        for part, which in ((ids, spaced), (rest, ~spaced)):
            to, _ = K.ragged(begin[which], n[which])
            out[to] = part
        return out, n

    def _lines(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces of any form: those without a line feed are encoded in one text, a line each."""
        alone = np.array([b"\n" in p or p[-1:].isspace() or p[:2].isspace() or not p for p in pieces], bool)
        lines = [pieces[i].decode() for i in np.flatnonzero(~alone)]
        ids = np.array(self.plain(["\n".join(lines) + "\n"])[0] if lines else [], np.uint32)
        feed = ids == self.feed
        ends = np.flatnonzero(feed)
        size = np.zeros(len(pieces), np.int64)
        if len(ends) != len(lines):  # a tokenizer that joins a line feed with what stands beside it
            each = self.plain(lines)
            size[~alone] = [len(x) for x in each]
            ids = np.array([x for e in each for x in e], np.uint32)
        else:
            size[~alone] = np.diff(ends, prepend=-1) - 1
            ids = ids[~feed]
        rest = self.plain([pieces[i].decode() for i in np.flatnonzero(alone)])
        size[alone] = [len(x) for x in rest]
        out = np.zeros(int(size.sum()), np.uint32)
        begin = np.cumsum(size) - size
        to, _ = K.ragged(begin[~alone], size[~alone])
        out[to] = ids
        to, _ = K.ragged(begin[alone], size[alone])
        out[to] = np.array([x for e in rest for x in e], np.uint32)
        return out, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the end id after each, and the number of each text's ids."""
        given = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(given, self.odd).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(len(given), bool)
        data, offsets = K.flat(pc.if_else(pa.array(whole), pa.scalar("", pa.large_string()), given) if whole.any() else given)
        begin = _cuts(data, offsets)
        ids, place, n = self.looked_up(data, begin)
        # what stands after each text: its end id, behind the ids of the texts that are encoded whole
        tail = [np.array([*x, END_ID], np.uint32) for x in self.plain([given[int(i)].as_py() for i in np.flatnonzero(whole)])]
        size = np.ones(len(given), np.int64)
        size[whole] = [len(x) for x in tail]
        at = np.full(len(given), len(ids))
        at[whole] = len(ids) + 1 + np.cumsum(size[whole]) - size[whole]
        after = np.searchsorted(begin, offsets[1:])
        index, ends = K.ragged(np.insert(place, after, at), np.insert(n, after, size))
        total = np.diff(ends[after + np.arange(1, len(after) + 1)], prepend=0)
        return np.concatenate([ids, np.array([END_ID], np.uint32), *tail])[index], total


_loaded: dict[str, PieceTokenizer] = {}


def loaded(path: str) -> PieceTokenizer:
    """The worker's tokenizer of this file, with what it remembers from earlier tasks."""
    if path not in _loaded:
        _loaded[path] = PieceTokenizer(path)
    return _loaded[path]


def _one(values: pa.Array) -> pa.Array:
    """A column of one row that lists all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


_SCHEMA = "part int, block int, doc_ids array<long>, lengths array<long>, n_ids long, coded binary"


def _encoded(path: str, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = loaded(path)
        docs: list[pa.Array] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        part, block = 0, 0

        def out() -> pa.RecordBatch:
            nonlocal block
            own = np.concatenate(ids)
            ids.clear()
            K.release()  # the coder takes as much again
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), _one(pa.concat_arrays(docs)), _one(pa.array(np.concatenate(sizes))), pa.array([len(own)], pa.int64()), pa.array([coder.encode(own, tokenizer.size)], pa.binary())],
                names=["part", "block", "doc_ids", "lengths", "n_ids", "coded"],
            )
            block += 1
            docs.clear()
            sizes.clear()
            return row

        for whole in batches:
            for batch in K.slices(whole, "text"):
                part = batch.column("part")[0].as_py()
                flat, n = tokenizer.encode(batch.column("text"))
                docs.append(batch.column("doc_id").cast(pa.int64()))
                sizes.append(n)
                ids.append(flat)
                if sum(map(len, ids)) >= block_ids:
                    yield out()
        if ids:
            yield out()
        K.release()  # but for the pieces it knows

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the token files of ``docs`` under ``path``, in ascending doc_id order over parts and blocks."""
    n = partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]  # the hash deals out rows that share an id, too
    ranged = docs.select("doc_id", "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    parted = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    parted.mapInArrow(_encoded(tokenizer, block_ids), _SCHEMA).write.parquet(path)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids = coder.decode(batch.column("coded")[r].as_py())
            n = batch.column("lengths")[r].values.to_numpy()
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(n)
            crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(n.tolist(), ends.tolist(), strict=True)]
            full = lambda name, r=r, n=n: pa.array(np.full(len(n), batch.column(name)[r].as_py(), np.int32))
            yield pa.RecordBatch.from_arrays([full("part"), full("block"), batch.column("doc_ids")[r].values, pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])
    K.release()


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files; start counts the ids of all documents before."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    sizes = written(files.select("part", "block", "n_ids"), "sizes")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before(Window.orderBy("part")).alias("part_start"))  # one row a part
    blocks = sizes.withColumnRenamed("n_ids", "n").select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_start"))
    starts = blocks.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("at"))
    # a row a block, and a block has a million ids: small beside the files
    rows = files.select("part", "block", "doc_ids", "lengths", "coded").mapInArrow(_decoded, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("at") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the token files into the shared folder and reads them back."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, block_ids)
    return read_tokens(spark, path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_tokens(spark, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"), default_tokenizer())
