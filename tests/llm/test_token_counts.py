"""Token counts against the libraries, text by text."""

import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pairforge.llm import token_counts as T

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"]
ODD = [
    None, "", " ", "  \n \t x", "a b", " a  b ", "it's we'll x", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c", "café J̌ Å ﬁ", "你好 世界", "tab\tend \r\n\r\n z", "x" * 5000, "<s>a</s>",
    "9 9 9a b9 ü b", "\U0001f600 a", "▁ a ▁b", "a ́b", "\x1c a\x85b", "a\n b\nc\n\nd",
]


def library(name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    tokenizer = Tokenizer.from_file(path)
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def texts(seed=3, n=150):
    rng = random.Random(seed)
    alphabet = ["the ", "of", " ", "  ", "\n", "ing", "A", "é", "'s", "7", ".", "\t", " ", "zx", "<|endoftext|>", ", ", "\n\n", "B c"]
    return ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("head", [100_000, 20])
def test_counts_are_the_librarys(spark, monkeypatch, name, head):
    monkeypatch.setattr(T, "HEAD", head)
    given = texts()
    rows = [(i, t, "x", "y", 1) for i, t in enumerate(given)] + [(None, "a b c", None, None, None), (3, "a twin id", "x", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, rest string, tag long").repartition(3)
    count = library(name)
    want = sorted(((i, len((t or "").encode()), count(t or "")) for i, t, *_ in rows), key=str)
    got = T.token_counts(docs, public_tokenizers.path(name), limit=30).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 30) for r in got)


def test_long_texts_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 1000)
    text = " ".join(random.Random(1).choices(["alpha", "beta's", "gamma\n", "7,", "déjà"], k=60_000))
    docs = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.token_counts(docs, public_tokenizers.path(FILES[0])).collect()}
    assert got == {1: library(FILES[0])(text), 2: 1}


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_counts(docs, public_tokenizers.path(FILES[0])).collect() == []


def test_the_query_counts_every_document(spark):
    got = {r.doc_id: r for r in T.op11_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    count = library(FILES[0])
    assert len(got) == len(docs)
    for d in docs:
        r, n = got[d.doc_id], count(d.text or "")
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d.text or "").encode()), n, n > 512)
