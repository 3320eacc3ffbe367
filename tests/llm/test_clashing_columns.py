"""Stages give back the columns and values of documents whatever the columns are called."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairforge.llm import mixing

NAMES = "_tag _id _no _of _kept _t _copy _position _text score items tag position copy no of coverage gone_id its_id own_id sid c0 c1 text_ label rank".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 60))) for _ in range(40)] + ["", None]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, *(f"{n}-{i}" for n in NAMES)) for i, t in enumerate(texts)]
    rows += [rows[5], (6, texts[6], "s2", *(f"{n}-again" for n in NAMES)), (None, texts[7], None, *([None] * len(NAMES))), (50, texts[8], "s1", *(f"{n}-50" for n in NAMES))]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_rows_come_back_as_they_were(spark, docs, tables, stage):
    out = stage[1](spark, docs, tables)
    assert out.schema == docs.schema
    given = Counter(tuple(r) for r in docs.collect())
    got = Counter(tuple(r) for r in out.collect())
    assert got and set(got) <= set(given)
    if stage[0] == "near_dedup":  # 42 texts of which null and empty are alike
        assert sum(got.values()) == 41 and max(got.values()) == 1
    assert stage[1](spark, docs.limit(0), tables).count() == 0


def test_mixing_takes_the_copies_of_the_plan(spark, docs):
    plan = mixing.mix(docs, whole=True).where("taken > 0").groupBy("doc_id", "tag").agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).alias("n")).collect()
    out = mixing.mixed_documents(docs).groupBy("doc_id", F.xxhash64("text").alias("tag")).count().collect()
    assert {(r.doc_id, r.tag): r.n for r in plan} == {(r.doc_id, r.tag): r["count"] for r in out}
