"""Greedy tiling against a brute-force version, word for word."""

import random

import numpy as np

from pairforge.llm import decontaminate


def plain_tiling(t, p, k):
    free_p, free_t, out = [True] * len(p), [True] * len(t), []
    while True:
        best = (0, 0, 0)
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < k:
            return out
        free_p[i : i + n], free_t[j : j + n] = [False] * n, [False] * n
        out.append((j, i, n))


def test_tiles_are_those_of_a_plain_greedy_tiling():
    rng = random.Random(2)
    for _ in range(150):
        kinds = rng.choice([3, 6, 40])
        p = [rng.randrange(kinds) for _ in range(rng.randrange(3, 30))]
        t = [x for i in (rng.randrange(len(p)) for _ in range(5)) for x in [*p[i : i + rng.randrange(3, 12)], *rng.choice([[], [99]])]]
        got = decontaminate.tiles(np.array(t, np.uint64), np.array(p, np.uint64), 3)
        assert sorted(got) == sorted(plain_tiling(t, p, 3))


def test_longer_items_quoted_in_overlapping_pieces():
    rng = random.Random(8)
    for n in (20, 30, 38, 40, 50, 60):
        for _ in range(12):
            p = list(range(n))
            t = [x for i in (rng.randrange(n) for _ in range(6)) for x in [*p[i : i + rng.randrange(5, 20)], *rng.choice([[], [99]])]]
            assert sorted(decontaminate.tiles(np.array(t, np.uint64), np.array(p, np.uint64), 5)) == sorted(plain_tiling(t, p, 5))


def test_one_word_said_over_and_over_ends_soon(spark):
    import time

    docs = spark.createDataFrame([(0, "again " * 30_000), (1, "again and " * 15_000), (2, "again")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "again " * 1_000), (2, "and again " * 400), (3, "again and again and again")], "item_id long, text string")
    began = time.time()
    got = {r.doc_id: list(r["found"]) for r in decontaminate.search(docs, bench).withColumnRenamed("items", "found").collect()}
    assert got == {0: [1], 1: [2, 3], 2: []}
    assert time.time() - began < 60


def test_blocks_and_repeated_items_change_nothing(spark):
    items = [(i, " ".join(f"b{i}w{j}" for j in range(12))) for i in range(30)]
    bench = spark.createDataFrame(items + [(100, items[3][1]), (None, items[4][1]), (5, items[5][1])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so {items[i][1].upper()} it was {items[i + 1][1]}") for i in range(0, 28, 3)] + [(None, items[4][1]), (None, items[4][1]), (50, None)], "doc_id long, text string")
    rows = lambda words: sorted(((r.doc_id, list(r["found"]), r.coverage) for r in decontaminate.search(docs, bench, block_words=words).withColumnRenamed("items", "found").collect()), key=repr)
    assert rows(200_000) == rows(70)
    got = {d: f for d, f, _ in rows(70)}
    assert got[3] == [3, 4, 100, None] and got[50] == [] and got[None] == [4, None]


def test_an_item_quoted_in_overlapping_pieces_is_found(spark):
    w = [f"p{i}" for i in range(20)]
    text = " ".join(["x1", *w[5:14], "x2", *w[:8], "x3", *w[14:], "x4"])
    docs = spark.createDataFrame([(0, text), (1, " ".join(w[5:14]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    got = {r.doc_id: (list(r["found"]), r.coverage) for r in decontaminate.search(docs, bench).withColumnRenamed("items", "found").collect()}
    assert got == {0: ([7], 1.0), 1: ([], 0.0)}


def test_a_benchmark_of_many_blocks_reads_the_suspects_alone(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 12, 40])))) for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, k=200))) for i in range(150)]
    for i in range(0, 150, 10):  # whole items, and items in pieces that are moved around
        w = items[i % 60][1].split()
        docs.append((1000 + i, f"so {' '.join(w[len(w) // 2 :])} and {' '.join(w[: len(w) // 2])} {docs[i][1]} {items[(i + 7) % 60][1]}"))
    docs += [(None, items[3][1]), (5000, None), (5001, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted(((r.doc_id, tuple(r["found"]), r.coverage) for r in decontaminate.search(d, b, **k).withColumnRenamed("items", "found").collect()), key=str)
    seen = []
    real = decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, name: (seen.append((name, real(df, name))), seen[-1][1])[1])
    want = rows()
    assert "suspects" not in dict(seen) and sum(bool(r[1]) for r in want) >= 16
    assert rows(block_words=200) == want
    assert sum(bool(r[1]) for r in want) <= dict(seen)["suspects"].count() < 40
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", 4)  # a full sieve stops nothing
    monkeypatch.setattr(decontaminate.Sieve, "__init__", lambda self, seeds: (setattr(self, "bits", 4), setattr(self, "map", np.zeros(2, np.uint8)))[0])
    assert rows(block_words=200) == want


def test_added_columns_get_names_of_their_own(spark):
    b = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so one two three four five six", "x", 0.5, "y"), (2, None, None, None, None)], "doc_id long, text string, Items string, coverage double, coverage_found string")
    out = decontaminate.search(docs, b)
    assert out.columns == [*docs.columns, "items_found", "coverage_found_found"]
    assert {r.doc_id: (r["Items"], r.coverage, r.items_found, r.coverage_found_found) for r in out.collect()} == {1: ("x", 0.5, [7], 1.0), 2: (None, None, [], 0.0)}
