"""The near-dedup stage against brute force over five-word shingle sets."""

import random
import re

import pytest

import corpus_pipeline
from pairforge.llm import near_dedup

SCHEMA = "doc_id long, text string, source string"


def shingle_set(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def kept_by_brute_force(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((least.get(find(i)) for i in {find(i) for i in range(len(rows))}), key=repr)


@pytest.mark.parametrize("sets, shingles, narrow", [(1_000, 400_000, 8), (3, 400, 1_000), (3, 400, 2)])
def test_near_dedup_stage_is_brute_force(spark, monkeypatch, sets, shingles, narrow):
    monkeypatch.setattr(near_dedup, "NARROW_BLOCKS", narrow)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", sets)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randrange(40, 160))] for _ in range(25)]
    texts = [" ".join(b) for b in base]
    for b in base:  # similarities on both sides of 0.8
        for _ in range(5):
            x = list(b)
            for _ in range(max(1, round(len(b) * rng.choice([0.005, 0.015, 0.02, 0.025, 0.03])))):
                x[rng.randrange(len(x))] = f"q{rng.randrange(10**6)}"
            texts.append(" ".join(x))
    chain = [rng.choice(words) for _ in range(200)]
    texts += [" ".join(chain[:i] + [f"c{j}" for j in range(i)] + chain[i:]) for i in range(0, 120, 4)]
    texts += ["", None, "  ", "one two", "One\ttwo", texts[3].upper()]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "alone with no id at all here", None), (3, texts[3], "s"), (None, texts[5], "s")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == kept_by_brute_force(rows)
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_wide_keys_are_brute_force(spark, monkeypatch):
    """All sets under a single key: families, chains and strangers that share a passage."""
    monkeypatch.setattr(near_dedup, "BANDS", 1)
    monkeypatch.setattr(near_dedup, "BLOCK_SETS", 4)
    monkeypatch.setattr(near_dedup, "NARROW_BLOCKS", 2)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for _ in range(6):
        base = [f"f{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(12):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(60)] = f"q{rng.randrange(10**6)}"
            texts.append(passage + " " + " ".join(x))
    texts += [passage + " " + " ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))) for _ in range(40)]
    chain = [f"c{i}" for i in range(120)]
    texts += [passage + " " + " ".join([f"d{j}" for j in range(i)] + chain[i:]) for i in range(0, 120, 6)]
    sids = list(range(1, len(set(texts)) + 1))
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(s, s, t) for s, t in zip(sids, texts, strict=True)], "doc_id long, tag long, text string")
    sets = [shingle_set(t) for t in texts]
    reps = spark.createDataFrame([(s, len(x), [7], (False, s, s)) for s, x in zip(sids, sets, strict=True)], "sid long, n int, bands array<long>, least struct<none:boolean,doc_id:long,tag:long>")
    found = [(r.u, r.v) for r in near_dedup.links(docs, reps).collect()]

    def classes(pairs):
        root = {s: s for s in sids}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {s: find(s) for s in sids}

    similar = {(i + 1, j + 1) for i, a in enumerate(sets) for j in range(i) if 5 * len(a & (b := sets[j])) >= 4 * len(a | b)}
    assert all((max(p), min(p)) in similar for p in found)
    assert classes(found) == classes(similar)
    assert 10 < len(set(classes(similar).values())) < len(sids)


def test_candidates_reach_pairs_at_the_threshold():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    texts = []
    for _ in range(400):  # one word replaced loses five of 45 shingles: 40 / 50
        x = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        texts += [" ".join(x), " ".join([*x[:20], "other", *x[21:]])]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], names=["doc_id", "tag", "text"])
    keys = np.concatenate([np.array(out.column("bands").to_pylist()) for out in near_dedup._sketches(5)(iter([batch]))])
    a, b = shingle_set(texts[0]), shingle_set(texts[1])
    assert len(a & b) * 5 == len(a | b) * 4
    assert (keys[::2] == keys[1::2]).any(axis=1).all()
    assert abs((keys[::2] == keys[1::2]).mean() - 0.8**near_dedup.ROWS) < 0.03


def test_fingerprints_link_sets_without_a_common_key(spark):
    """The SimHash index alone connects the nearest copies, verified on their shingles; MinHash keys of connected sets are left out."""
    import pyarrow as pa

    rng = random.Random(9)
    texts = []
    for _ in range(12):
        x = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(x), " ".join([*x[:-1], "other"]), " ".join(x[:150] + [f"v{rng.randrange(10**6)}" for _ in range(150)])]
    texts += ["", "a b c d e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "tag", "text"])
    rows = [r for out in near_dedup._sketches(5)(iter([batch])) for r in out.to_pylist()]
    near = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows[:i]) if ((a["fp"] ^ b["fp"]) & (1 << 64) - 1).bit_count() <= near_dedup.RADIUS}
    sets = [shingle_set(t) for t in texts]
    similar = {(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(similar) >= 8
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, tag long, text string")
    schema = "sid long, n int, fp long, bands array<long>, least struct<none:boolean,doc_id:long,tag:long>"
    reps = spark.createDataFrame([(i, r["n"], r["fp"], [i], (False, i, i)) for i, r in enumerate(rows)], schema)
    known = near_dedup.fingerprint_links(docs, reps)
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in known.collect()} == similar
    found = near_dedup.links(docs, reps, known=known)
    assert {(max(r.u, r.v), min(r.u, r.v)) for r in found.collect()} == similar


@pytest.mark.parametrize("votes", [1 << 16, 7])
def test_majorities_are_those_of_a_count(monkeypatch, votes):
    import numpy as np

    monkeypatch.setattr(near_dedup.simhash, "VOTES", votes)
    rng = np.random.default_rng(1)
    n = np.array([0, 3, 0, 0, 20, 1, 14, 7, 0])
    h = rng.integers(0, 1 << 64, n.sum(), np.uint64, endpoint=False)
    cut = np.concatenate(([0], np.cumsum(n)))
    want = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h[a:c]) > c - a) for a, c in zip(cut[:-1], cut[1:], strict=True)]
    assert near_dedup.simhash.majority(h, cut).tolist() == want
