"""Rows of like size that meet in blocks, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from pairforge.operators import blocks, dedup, similar


def grams(x):
    return {x} if 0 < len(x) < 3 else {x[i : i + 3] for i in range(len(x) - 2)}


def near(a, b, t=0.7):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) >= t


def texts(seed, n):
    """Words of few syllables of 2 to 400 characters, a third of them changed copies of others."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        t = "".join(rng.choice(["en", "tre", "la", "that", "ing", "er"]) for _ in range(rng.choice([1, 2, 2, 3, 4, 8, 20, 60, 120])))
        if out and rng.random() < 0.35:
            t = list(rng.choice(out))
            t[rng.randrange(len(t))] = rng.choice(["m", "ex", ""])
            t = "".join(t)
        out.append(t or "a")
    return sorted(set(out), key=lambda x: rng.random())


@pytest.mark.parametrize(("gain", "rows", "bytes_"), [(100, 1_000, 64 << 20), (1e9, 7, 64 << 20), (1e9, 7, 1_000), (0, 1_000, 64 << 20)])
def test_edges_and_duplicates_equal_all_pairs(spark, monkeypatch, gain, rows, bytes_):
    """In one cell, in many, in cells of one row, and by keys."""
    monkeypatch.setattr(similar, "PAIRS_A_MEETING", gain)
    monkeypatch.setattr(similar, "RANGE_PAIRS", 2_000)
    monkeypatch.setattr(blocks, "LEAST_ROWS", rows)
    monkeypatch.setattr(blocks, "CELL_BYTES", bytes_ if bytes_ > 1_000 else 50 * similar._GRAMS // 8)
    met, cells = [], []
    monkeypatch.setattr(blocks, "matches", lambda *a, f=blocks.matches: (met.append(1), f(*a))[1])
    monkeypatch.setattr(blocks, "_cells", lambda *a, f=blocks._cells: (cells.append(sum(x[2] for x in f(*a))), f(*a))[1])
    some = texts(int(rows), 240)
    df = spark.createDataFrame(list(enumerate(some)), "id int, instruction string").withColumn("ord", F.col("id"))
    want = {(i, j) for j in range(len(some)) for i in range(j) if near(some[i], some[j])}
    assert {(r.i, r.j) for r in dedup.near_duplicate_edges(df, 0.7).collect()} == want and want
    assert bool(met) == (gain > 0) and (gain < 1e9 or max(cells) > 10)
    by = {}
    for i, j in sorted(want, key=lambda e: (e[1], e[0])):
        if i not in by and j not in by:
            by[j] = i
    assert {r.dup_id: r.keep_id for r in dedup.find_duplicates(df, 0.7).collect()} == by


def test_a_late_family_does_not_meet_pair_by_pair(spark, monkeypatch):
    """Ranges grow, but not over a family that stands at the end."""
    rng, base = random.Random(9), "what is the colour of the sky at noon over the old harbour of the town"
    some = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(900)] + [base + " " + "".join(rng.choices("abcxyz", k=3)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(dict.fromkeys(some))), "id int, instruction string").withColumn("ord", F.col("id"))
    monkeypatch.setattr(similar, "PAIRS_A_MEETING", 1e9)
    monkeypatch.setattr(similar, "RANGE_PAIRS", 400)
    made = []
    monkeypatch.setattr(similar, "settled", lambda edges, f=similar.settled: (made.append(edges.count()), f(edges))[1])
    found = dedup.find_duplicates(df, 0.7)
    assert found.select("keep_id").distinct().collect() == [(900,)] and found.count() == df.count() - 901
    assert sum(made) < 6_000  # of about 15,000 pairs
