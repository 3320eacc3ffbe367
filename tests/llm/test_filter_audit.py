"""The filter audit against a plain count over all orders, and its tries against a dictionary."""

import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairforge.llm import filter_audit as A


def fails(text):
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return {f for f, bad in zip("ABCD", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * capitals > 5 * len(text), any(c in "#$%&*|" for c in text)), strict=True) if bad}


def model(docs, labels):
    """Rows for (doc_id, source, text), filter by filter in each order."""
    least = {}
    for i, _, t in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    own = [(i, s or "", fails(t) | ({"E"} if i is not None and least[t or ""] < i else set())) for i, s, t in docs]
    out, shapley = {}, Counter()
    good, toxic = ({d for d, *v in labels if d is not None and v[k] == 1} for k in (0, 1))
    for part in {s for _, s, _ in own}:
        rows = [(i, f) for i, s, f in own if s == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            here = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in here if name in r[1]]
                here = [r for r in here if name not in r[1]]
                failing = [r for r in rows if name in r[1]]
                out[part, order, step] = [len(here), len(gone), len(failing) - len(gone), sum(r[1] == {name} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
                shapley[part, name] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def counted(frame):
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in frame.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def corpus(seed=8, n=260):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(90)] + ["CAPS", "a#b", "é x", "50%"]
    base = [" ".join(rng.choice(words[: rng.choice([5, 60, 90, 94])]) for _ in range(rng.choice([3, 49, 50, 51, 200]))) for _ in range(90)]
    docs = [(rng.randrange(400), rng.choice([None, "", "web", "books"]), rng.choice(base)) for _ in range(n)]
    docs += [(None, "web", base[0]), (None, None, None), (5, "web", ""), (4, "web", None), (900, "web", "A" * 5), (901, "x", "a" * 300_000), (902, "x", "a" * 300_000 + "b"), docs[0], docs[0]]
    docs += [(1000 + i, "hot", base[1]) for i in range(120)] + [(2000 + i, "hot", "shared head " * 20 + str(i % 40)) for i in range(160)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 2200, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    return docs, labels


@pytest.mark.parametrize("limit", [32 << 20, 3000])
def test_counts_are_those_of_the_model(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "TRIE_BYTES", limit)
    docs, labels = corpus()
    frame = spark.createDataFrame([(*d, 1, "y") for d in docs], "doc_id long, source string, text string, mask int, part string").repartition(7)
    assert counted(A.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == model(docs, labels)


def test_empty_tables(spark):
    none, unlabelled = spark.createDataFrame([], "doc_id long, source string, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(none, unlabelled).collect() == []
    assert len(A.audit(spark.createDataFrame([(1, None, None)], none.schema), unlabelled).collect()) == 600


@pytest.mark.parametrize("limit", [1 << 30, 500])
def test_tries_tell_the_least_id(monkeypatch, limit):
    monkeypatch.setattr(A, "TRIE_BYTES", limit)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(3000)]
    rows = sorted(((t, rng.choice([None, rng.randrange(50)]), i) for i, t in enumerate(texts)), key=lambda r: (r[0], r[1] is None, r[1] or 0))
    least, many = defaultdict(list), Counter(texts)
    for t, i, _ in rows:
        if i is not None:
            least[t].append(i)
    batches = [pa.RecordBatch.from_pydict({"tag": [r[2] for r in part], "text": [r[0] for r in part], "own_min": [r[1] for r in part]}) for part in (rows[k : k + 100] for k in range(0, len(rows), 100))]
    got = [(r["tag"], r["least"]) for b in A._least_ids(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == sorted((i, min(least[t])) for t, _, i in rows if many[t] > 1 and least[t])


def test_prefix_keys_sort_as_the_texts_and_part_a_shared_head(spark):
    texts = ["h" * 70_000 + f"{i:03d}" for i in range(200)] + ["same" * 10] * 100 + [f"{i} other" for i in range(50)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tag long, text string").select("tag", F.col("text").cast("binary").alias("text"))
    frame = frame.withColumn("own_min", F.col("tag")).withColumn("lead", A._code(F.col("text"), F.lit(0)))
    keyed, keys = A.with_prefix_keys(frame, 8)
    rows = keyed.select("text", *keys).collect()
    assert len(keys) > 1
    ordered = [bytes(r.text) for r in sorted(rows, key=lambda r: tuple(r)[1:])]
    assert [t[:70_004] for t in ordered] == sorted(bytes(r.text)[:70_004] for r in rows)
    assert len({tuple(r)[1:] for r in rows if bytes(r.text).startswith(b"hhh")}) == 200


def test_the_query_is_the_sql_and_the_model(spark):
    d = "/root/testdata/sf0.001"
    got = counted(A.op13_filter_audit(spark, d))
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got == model(docs, [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect()])
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{d}/{name}.parquet')")
    assert {tuple(r[:3]): tuple(r[3:]) for r in con.execute(A.OP13_SQL).fetchall()} == got


def test_prefix_keys_join_nothing(spark):
    """Levels of prefixes are looked up in one pass: records are not joined with each level again."""
    texts = ["h" * 300 + f"{i % 3}" + "m" * 50 + f"{i % 5}" + "t" * 40 + f"{i:03d}" for i in range(200)] + [f"{i} other" for i in range(50)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "tag long, text string").select("tag", F.col("text").cast("binary").alias("text"))
    frame = frame.withColumn("own_min", F.col("tag")).withColumn("lead", A._code(F.col("text"), F.lit(0)))
    keyed, keys = A.with_prefix_keys(frame, 8)
    assert len(keys) > 2
    assert "Join" not in keyed._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(keyed.select(*keys, "text").collect(), key=lambda r: tuple(r)[:-1])
    assert len(rows) == 250
    heads = {}
    for r in rows:
        heads.setdefault(tuple(r)[:-1], []).append(bytes(r.text))
    assert all(max(a) < min(b) for a, b in zip(list(heads.values()), list(heads.values())[1:]))
