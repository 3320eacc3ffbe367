"""Importance resampling against a plain model, and the position-table CRC against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from pairforge.llm import resampling as R


def model(docs, target, percent=5, min_words=20):
    """The rows for (doc_id, text) pairs by the definition, feature by feature."""
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    rows = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_the_crc_is_that_of_zlib():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(5000)), np.uint8)
    sizes = [*range(0, 3 * R.REACH + 2), 1000, 4096]
    starts = np.array([rng.randrange(0, 5000 - n) for n in sizes])
    ends = starts + np.array(sizes)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert R.crc32(data, starts, ends).tolist() == want
    assert R.crc32(data, starts[:0], ends[:0]).tolist() == []


def test_rows_are_those_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(R, "_BLOCK", 50)  # features run over the edges of blocks
    rng = random.Random(4)
    words = ["the", "Of", "é", "x9", "A" * 70, "Straße", "zz" * 150, "1", "naïve"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 90))) for i in range(200)]
    docs += [(500, None), (501, ""), (502, " \x7f- "), (3, docs[3][1]), (3, docs[3][1]), (None, docs[5][1]), (None, None), (503, text(3000)), *((600 + i, docs[7][1]) for i in range(30))]
    target = [text(40) for _ in range(5)] + [None, ""]
    frame = spark.createDataFrame([(i, t, "w", 1.5, 2) for i, t in docs], "doc_id long, text string, weight string, score double, tag int").repartition(4)
    got = R.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(map(tuple, got), key=str) == model(docs, target)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resampled(none, none).collect() == []
    some = [(1, "a b c"), (2, "a " * 25)]
    got = R.resampled(spark.createDataFrame(some, "doc_id long, text string"), none).collect()
    assert sorted(map(tuple, got), key=str) == model(some, [])


def test_the_query_is_the_model_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    frame = R.op12_resampling(spark, d)
    assert all(kind == "bigint" for _, kind in frame.dtypes)
    assert sorted(map(tuple, frame.collect()), key=str) == model(docs, target)
