"""What the mix takes of each document against a plain sequential version."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pairforge.llm import mixing


def taken_by_model(rows):
    """rows: (hash of the id, doc_id, tag, source, text); {(doc_id, tag): taken}, of rows with distinct keys."""
    size = [len([w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]) for *_, t in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_sources, left = {}, set(sources), 1.5 * sum(size)
    while open_sources:
        level = left / sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if weight[s] * level > 2 * total[s]]
        for s in over or list(open_sources):
            target[s] = 2 * total[s] if over else weight[s] * level
            left -= target[s]
            open_sources.discard(s)
    out = {}
    for s in sources:
        own = sorted((h % 2**64, d is not None, d or 0, n, tag, d) for n, (h, d, tag, x, _) in zip(size, rows) if x == s)
        at, epochs = 0, int(target[s] // total[s]) if total[s] else 0
        for _, _, _, n, tag, d in own:
            rest = int(target[s] - epochs * total[s] + 0.5) - at
            out[d, tag] = epochs * n + max(0, min(n, rest))
            at += n
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_taken_words_equal_the_model(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    rng = random.Random(seed)
    rows = []
    for i in range(300):  # one source holds a third of all rows
        source = "big" if i % 3 == 0 else rng.choice(["a", "b", "c", None, "\u00e9"])
        rows.append((i, " ".join("w" for _ in range(rng.randrange(0, 40 if source != "a" else 3))), source))
    rows += [(300, None, "a"), (301, "", "only empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select(F.xxhash64(F.col("doc_id").cast("string"), F.xxhash64("text")).alias("h"), "doc_id", F.xxhash64("text").alias("tag"), "source", "text")
    want = taken_by_model([tuple(r) for r in keyed.collect()])
    got = {(r.doc_id, r.tag): r.taken for r in mixing.mix(docs).collect()}
    assert got == want


def test_equal_rows_and_null_ids_are_spread(spark, monkeypatch):
    """A third of null ids fall into many slices, and rows that are equal are one unit of them."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 50)
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"), F.lit("one").alias("source"))
    seen = []
    real = mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name: (seen.append((name, real(df, name))), seen[-1][1])[1])
    assert mixing.mix(docs).count() == 3000
    units = dict(seen)["units"]
    assert units.groupBy(F.shiftrightunsigned("h", 64 - 6)).count().agg(F.max("count")).first()[0] < 100
    same = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("one two three").alias("text"), F.lit(None).cast("string").alias("source"), F.lit("x").alias("lang"))
    rest = spark.createDataFrame([(1, "a b", "s", "y"), (1, "a b", "s", "z"), (1, "a b", "t", "u"), (None, "c", "s", "v")], "doc_id int, text string, source string, lang string")
    out = mixing.mixed_documents(same.union(rest), share=1.0, max_epochs=1.0)
    assert dict(seen)["units"].where("doc_id = 7").count() == 1
    got = {tuple(r)[:4]: r["count"] for r in out.groupBy(*out.columns).count().collect()}
    assert got == {(7, "one two three", None, "x"): 20_000, (1, "a b", "s", "y"): 1, (1, "a b", "s", "z"): 1, (1, "a b", "t", "u"): 1, (None, "c", "s", "v"): 1}
