"""Token counts of whole texts from distinct pre-tokens, without ids.

A pre-token is a stretch of text that the tokenizer never joins with its
neighbours, so a text's count is the sum of its pre-tokens' counts:

1. every task cuts its texts and counts its distinct pre-tokens; the table of
   distinct pre-tokens of the corpus follows by one aggregation;
2. each distinct pre-token is tokenised once and its number of tokens kept;
3. each text's pre-token frequencies are joined with that table and summed.

The join is in two parts, since a few pre-tokens make up most of any corpus: the
``HEAD`` most frequent ones at most, a table of bounded size, go to every task;
the frequencies of the others are shuffled by pre-token, none of which is hot.

Files of the tokenizers library (.json) and of sentencepiece (.model) are known.
Where it can't be shown that a tokenizer cuts at the places used here, a whole
text is one pre-token.

Defined cases: null or empty text has 0 bytes and 0 tokens; rows that repeat a
doc_id each count; a null doc_id stays null; an empty table gives no rows; other
columns are ignored; a text of any length is counted whole, in blocks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm import tokens
from pairforge.llm.common import sized, table, written

#: Pre-tokens that every task gets at most, and the bytes of the longest among them: 100,000 * (32 + 16) bytes, 5 MB.
HEAD, HEAD_BYTES = 100_000, 32
#: Tokens from which on a text is over the limit.
LIMIT = 512
#: Text handled at once.
BLOCK = 2 << 20

#: Pre-tokens of some rows: the rows, their bytes, where pre-tokens begin and end, the offsets of each row's, and tokens counted beside them.
Cut = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each."""

    def cut(self, texts: pa.Array) -> Iterator[Cut]:
        """All rows, those without a pre-token included at least once."""
        data, offsets = K.flat(texts)
        full = np.flatnonzero(np.diff(offsets))
        yield np.arange(len(texts)), data, offsets[full], offsets[full + 1], np.searchsorted(full, np.arange(len(texts) + 1)), np.zeros(len(texts), np.int64)

    def count(self, pieces: list[bytes]) -> list[int]:
        raise NotImplementedError


def _listed(rows: np.ndarray, pieces: list[list[str]], extra: list[int]) -> Cut:
    raw = [[p.encode() for p in own] for own in pieces]
    ends = np.cumsum([len(p) for own in raw for p in own], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum([len(own) for own in raw], dtype=np.int64)))
    return rows, np.frombuffer(b"".join(p for own in raw for p in own), np.uint8), np.concatenate(([0], ends[:-1])) if len(ends) else ends, ends, offsets, np.array(extra, np.int64)


class JsonCounter(Counter):
    """A file of the tokenizers library. ``kind`` says what is cut: bytes, the file's own pre-tokens, or nothing."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        parts = json.loads(self.tokenizer.to_str())
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")") if added else None
        cutter = parts["pre_tokenizer"] or {}
        plain = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        if plain and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not parts["normalizer"]:
            self.kind = "bytes"
        elif plain and cutter and "Metaspace" not in json.dumps(cutter) and '"add_prefix_space": true' not in json.dumps(cutter):
            self.kind = "pieces"
        else:
            self.kind = "whole"
        #: Texts that are cut by the file's own rules: with an added token or white space beyond ASCII.
        self.odd = "|".join([tokens._WIDE, *(re.escape(t.content) for t in added)])

    def own(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens by the file's own rules, and how many added tokens stand between them."""
        out, extra = [], 0
        for i, section in enumerate(self.special.split(text) if self.special else [text]):
            if i % 2:
                extra += 1
            elif section:
                if self.tokenizer.normalizer:
                    section = self.tokenizer.normalizer.normalize_str(section)
                parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(section)
                out += [section[a:b] for _, (a, b) in parts] if self.kind == "bytes" else [p for p, _ in parts]
        return out, extra

    def cut(self, texts: pa.Array) -> Iterator[Cut]:
        if self.kind == "whole":
            yield from super().cut(texts)
            return
        given = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(given, self.odd).to_numpy(zero_copy_only=False) if self.kind == "bytes" else np.ones(len(given), bool)
        rows = np.flatnonzero(odd)
        if len(rows):
            found = [self.own(given[int(i)].as_py()) for i in rows]
            yield _listed(rows, [f[0] for f in found], [f[1] for f in found])
        if len(rows) < len(given):
            rest = np.flatnonzero(~odd)
            data, offsets = K.flat(given.filter(pa.array(~odd)))
            begin = tokens._cuts(data, offsets)
            # a text's cuts must not hang on where in a slice it stands: no slice's ends differ from rows' ends within it
            edge = np.isin(begin, [1, len(data) - 1, len(data)]) & ~np.isin(begin, offsets[:-1][offsets[:-1] < len(data)])
            begin = begin[~edge]
            yield rest, data, begin, np.append(begin[1:], len(data))[: len(begin)], np.searchsorted(begin, offsets), np.zeros(len(rest), np.int64)

    def count(self, pieces: list[bytes]) -> list[int]:
        texts = [p.decode() for p in pieces]
        if self.kind == "pieces":
            return [len(self.tokenizer.model.tokenize(t)) for t in texts]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class ModelCounter(Counter):
    """A sentencepiece file. Where no piece goes on beyond a word's end, texts are cut at single spaces between ASCII letters and digits."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        whole = all("▁" not in p.lstrip("▁") for p in pieces)
        one, two = self.model.encode(["b7", "a b7"])
        self.cuttable = whole and self.model.encode("a") + one == two

    def cut(self, texts: pa.Array) -> Iterator[Cut]:
        if not self.cuttable:
            yield from super().cut(texts)
            return
        data, offsets = K.flat(texts)
        plain = K.ALNUM[K.LOWER[data]] & (data < 0x80)
        space = np.zeros(len(data), bool)
        space[1:-1] = (data[1:-1] == 0x20) & plain[:-2] & plain[2:]
        near = offsets[1:-1]  # what stands in another row doesn't count
        for d in (-1, 0):
            at = near + d
            space[at[(at >= 0) & (at < len(data))]] = False
        full = np.diff(offsets) > 0
        gaps = np.flatnonzero(space)
        starts, ends = np.sort(np.concatenate([offsets[:-1][full], gaps + 1])), np.sort(np.concatenate([gaps, offsets[1:][full]]))
        yield np.arange(len(texts)), data, starts, ends, np.searchsorted(starts, offsets), np.zeros(len(texts), np.int64)

    def count(self, pieces: list[bytes]) -> list[int]:
        return [len(x) for x in self.model.encode([p.decode() for p in pieces], num_threads=1)]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The worker's counter for this file."""
    if path not in _counters:
        _counters[path] = ModelCounter(path) if path.endswith(".model") else JsonCounter(path)
    return _counters[path]


def _blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of pre-tokens of about ``BLOCK`` bytes."""
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, "right")))
        yield first, last
        first = last


def _distinct(path: str):
    """Each block's distinct pre-tokens and how often they stand in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for whole in batches:
            for batch in K.slices(whole, "text"):
                for _, data, starts, ends, _, _ in own.cut(batch.column("text")):
                    for lo, hi in _blocks(starts, ends):
                        coded = K.gather(data, starts[lo:hi], ends[lo:hi]).dictionary_encode()
                        n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.binary()), pa.array(n.astype(np.int64))], names=["piece", "n"])

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("piece", "n")), pa.array(own.count(batch.column("piece").to_pylist()), pa.int64())], names=["piece", "n", "tokens"])

    return run


def counted_pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(piece, n, tokens): the distinct pre-tokens of all texts, how often each occurs, and its number of tokens."""
    found = docs.select("text").mapInArrow(_distinct(tokenizer), "piece binary, n long")
    return written(found.groupBy("piece").agg(F.sum("n").alias("n")).mapInArrow(_counted(tokenizer), "piece binary, n long, tokens long"), "pieces")


def _head(pieces: DataFrame) -> int:
    """The least frequency at which the short pre-tokens are at most ``HEAD``: from counts by eighths of an octave, at most 512 rows."""
    level = F.floor(8 * F.log2("n")).cast("long")
    room, least = HEAD, None
    for row in pieces.where(F.length("piece") <= HEAD_BYTES).groupBy(level.alias("level")).agg(F.count("*").alias("rows"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        room -= row["rows"]
        if room < 0:
            break
        least = row["least"]
    return least if least is not None else 1 << 62


def _summed(path: str, head):
    """Of each text: its bytes, the tokens of its pre-tokens in the head, and the frequencies of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        known, worth = head.value
        for whole in batches:
            for batch in K.slices(whole, "text"):
                texts = batch.column("text")
                total = np.zeros(batch.num_rows, np.int64)
                left: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
                for rows, data, starts, ends, offsets, extra in own.cut(texts):
                    total[rows] += extra
                    row = np.repeat(rows, np.diff(offsets))
                    for lo, hi in _blocks(starts, ends):
                        coded = K.gather(data, starts[lo:hi], ends[lo:hi]).dictionary_encode()
                        n = len(coded.dictionary)
                        pair, often = np.unique(row[lo:hi] * n + coded.indices.to_numpy(), return_counts=True)  # a row's frequencies
                        place = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.binary()), value_set=known), -1).to_numpy(zero_copy_only=False)
                        code = pair % n
                        met = place[code] >= 0
                        np.add.at(total, pair[met] // n, often[met] * worth[place[code[met]]])
                        if not met.all():
                            left.append((pair[~met] // n, often[~met], coded.dictionary.take(pa.array(code[~met])).cast(pa.binary())))
                row = np.concatenate([x[0] for x in left]) if left else np.empty(0, np.int64)
                order = np.argsort(row, kind="stable")
                piece = pa.concat_arrays([x[2] for x in left]).take(pa.array(order)) if left else pa.array([], pa.binary())
                often = np.concatenate([x[1] for x in left])[order] if left else np.empty(0, np.int64)
                rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(batch.num_rows + 1)).astype(np.int32)), pa.StructArray.from_arrays([piece, pa.array(often)], names=["piece", "n"]))
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(total), rest], names=["doc_id", "n_bytes", "head", "rest"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each document; ``tokenizer`` is the path of the file."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = counted_pieces(given, tokenizer)
    least = _head(pieces)
    in_head = (F.col("n") >= least) & (F.length("piece") <= HEAD_BYTES)
    known = pieces.where(in_head).select("piece", "tokens").toArrow()
    head = docs.sparkSession.sparkContext.broadcast((known.column("piece").combine_chunks().cast(pa.binary()), known.column("tokens").to_numpy()))
    kind = "doc_id long, n_bytes long, head long, rest array<struct<piece:binary,n:long>>"
    summed = written(given.mapInArrow(_summed(tokenizer, head), kind).withColumn("tag", F.monotonically_increasing_id()), "summed")
    rare = summed.where(F.size("rest") > 0).select("tag", F.explode("rest").alias("r")).select("tag", "r.piece", F.col("r.n").alias("often"))
    worth = F.coalesce("tokens", F.raise_error(F.lit("a pre-token was not counted: the texts changed between two reads")).cast("long"))
    joined = rare.join(pieces.where(~in_head).select("piece", "tokens"), "piece", "left").groupBy("tag").agg(F.sum(F.col("often") * worth).alias("tail"))
    n = F.col("head") + F.coalesce("tail", F.lit(0))
    return summed.drop("rest").join(sized(written(joined, "tail"), 16), "tag", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokens.default_tokenizer())
