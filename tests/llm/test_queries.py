"""Registered queries over whole tables against plain versions of their contracts."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_mixing_model import taken_by_model
from test_tiling import plain_tiling

from pairforge.llm import decontaminate, mixing, simhash, tokens

D = "/root/testdata/sf0.001"
SPACED = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text", "source").collect()


def test_op3_mixing(spark, documents):
    keyed = spark.read.parquet(f"{D}/documents.parquet").select(F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")).alias("h"), "doc_id", F.xxhash64("text").alias("tag"), "source", "text")
    want = {d: n for (d, _), n in taken_by_model([tuple(r) for r in keyed.collect()]).items()}
    got = mixing.op3_mixing(spark, D).collect()
    assert {r.doc_id: r.taken for r in got} == want and len(got) == len(documents)
    size = {d.doc_id: len(SPACED.findall(d.text or "")) for d in documents}
    total, taken, target = defaultdict(int), defaultdict(int), {}
    source = {d.doc_id: d.source for d in documents}
    for r in got:
        assert r.size == size[r.doc_id] and r.taken <= 2 * r.size and (r.position is not None) == (r.taken > 0)
        total[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(r.source_size == total[source[r.doc_id]] for r in got)
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items()) and abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-3


def test_op8_simhash(spark, documents):
    prints = {}
    for d in documents:
        w = SPACED.findall(lower(d.text))
        shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        prints[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash.op8_simhash(spark, D).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", find(i)) for i in ids} and len(got) == len(ids)


def test_op9_decontaminate(spark, documents):
    items = [(r.item_id, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    numbers: dict = {}
    code = lambda ws: [numbers.setdefault(w, len(numbers)) for w in ws]
    items = [(i, code(w)) for i, w in items]
    seeds = defaultdict(set)
    for k, (_, w) in enumerate(items):
        for q in range(len(w) - 4):
            seeds[tuple(w[q : q + 5])].add(k)
    got = {r.doc_id: r for r in decontaminate.op9_decontaminate(spark, D).collect()}
    assert len(got) == len(documents)
    for d in documents:
        w = code(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d.text)))
        near = {k for q in range(len(w) - 4) for k in seeds.get(tuple(w[q : q + 5]), ())}
        found = {}
        for k in near:
            share = sum(n for _, _, n in plain_tiling(w, items[k][1], 5)) / len(items[k][1]) if len(w) < 1500 else None
            if share is None:
                share = sum(n for _, _, n in decontaminate.tiles(np.array(w, np.uint64), np.array(items[k][1], np.uint64), 5)) / len(items[k][1])
            if share >= 0.8:
                found[items[k][0]] = share
        r = got[d.doc_id]
        assert (r.contaminated, r.n_items, r.item_ids) == (bool(found), len(found), ",".join(map(str, sorted(found)))), d.doc_id
        assert abs(r.coverage - max(found.values(), default=0)) < 1e-9


def test_op10_tokens(spark, documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    got = {r.doc_id: tuple(r)[1:] for r in tokens.op10_tokens(spark, D).collect()}
    start = 0
    for d in sorted(documents, key=lambda d: d.doc_id):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        assert got.pop(d.doc_id) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got
