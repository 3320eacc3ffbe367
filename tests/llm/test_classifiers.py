"""The two classifiers' queries: folds, forbidden inputs, odd texts, and what the counterfactual penalty does."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairforge.llm import language, toxicity

SYLLABLES = {"en": ["th", "ing", "wo"], "de": ["sch", "\u00fcr", "gel"], "fr": ["eau", "qu\u00e9", "oir"]}


def is_held_out(d):
    return d is not None and zlib.crc32(str(d).encode()) % 3 == 1


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(240):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(2)) for _ in range(25)]
        if i % 4 == 0:
            words.append("vile")
        docs.append((i, " ".join(words), lang, f"s{i % 2}"))
        labels.append((i, int(i % 4 == 0)))
    docs += [(240, None, "en", None), (241, "", None, "s"), (242, "12 34 !", "de", "s"), (None, docs[0][1], None, None), (3, docs[3][1], "en", "s1"), (243, docs[4][1] + " " + "vile " * 9000, "en", "s")]
    return docs, [*labels, (0, 0), (None, 1), (241, None)]


def test_toxicity_learns_from_its_folds_alone(spark, corpus, tmp_path):
    docs, labels = corpus
    rows = lambda folder: {(r.doc_id, r.held_out): (r.score, r.predicted) for r in toxicity.op7_toxicity(spark, folder).collect()}
    got = toxicity.op7_toxicity(spark, write(spark, str(tmp_path / "a"), docs, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held) and any(r.predicted for r in held)
    assert {r.predicted for r in got if r.doc_id in (240, 241, 242)} == {0} and [r.predicted for r in got if r.doc_id == 243] == [1]
    # labels of the held-out fold, languages, sources and the order of rows have no say
    turned = [(d, 1 - t if t is not None and is_held_out(d) else t) for d, t in labels]
    other = [(d, t, "xx", "y") for d, t, _, _ in docs][::-1]
    assert rows(str(tmp_path / "a")) == rows(write(spark, str(tmp_path / "b"), other, turned))


def test_language_learns_from_its_folds_alone(spark, corpus, tmp_path):
    docs, labels = corpus
    got = language.op2_language(spark, write(spark, str(tmp_path / "a"), docs, labels)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (240, 241, 242))
    assert all(r.lang_pred == sorted(SYLLABLES)[r.doc_id % 3] for r in got if r.held_out and r.doc_id < 240)
    turned = [(d, t, "zz" if is_held_out(d) else x, "y") for d, t, x, _ in docs][::-1]
    rows = lambda folder: sorted(((r.doc_id, r.lang_pred, r.score) for r in language.op2_language(spark, folder).collect()), key=repr)
    assert rows(str(tmp_path / "a")) == rows(write(spark, str(tmp_path / "b"), turned, labels))


def test_samples_keep_their_bound_with_repeated_ids(spark):
    rows = [(None if i % 3 else 7, f"text {i % 50} of \u00e9t\u00e9", f"l{i % 2}", i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    assert language.train(df, max_rows=100).langs == ["l0", "l1"]
    assert len(toxicity.train(df, max_rows=100)[0]) >= 0
    from pairforge.llm.common import drawn

    wide = spark.range(200_000).withColumn("h", F.xxhash64("id"))
    for rate in (0.0, 1e-3, 0.25, 1.0):
        n = drawn(wide, "h", F.lit(rate)).count()
        assert abs(n - rate * 200_000) <= 5 * (rate * (1 - rate) * 200_000) ** 0.5


MENTIONS = {"en": "muslims", "de": "juden", "fr": "immigr\u00e9s", "es": "inmigrantes"}


def neutral_mentions_flagged(spark, penalty):
    """Of 25 neutral sentences a language: how many a model flags with a term and not without it, having learnt from labels that mention the term more often."""
    rng = random.Random(4)
    rows, neutral = [], []
    for lang, term in MENTIONS.items():
        plain = [f"{lang}{i}" for i in range(60)]
        for i in range(160):
            text = [rng.choice(plain) for _ in range(12)]
            if i % 2 and i % 6 != 1:
                text.append("vile")
            if i % 2 and rng.random() < 0.8:
                text.append(term)
            rows.append((len(rows), " ".join(text), i % 2))
        for _ in range(25):
            sentence = " ".join(rng.choice(plain) for _ in range(8))
            neutral.append((len(neutral), lang, sentence, f"{sentence} {term}"))
    options = {} if penalty is None else {"swap_penalty": penalty}
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), **options)
    given = spark.createDataFrame(neutral, "doc_id long, lang string, without string, with string")
    score = lambda c: toxicity.scored(given.select("doc_id", F.col(c).alias("text")), model).select("doc_id", F.col("score").alias(f"of_{c}"))
    both = given.join(score("with"), "doc_id").join(score("without"), "doc_id")
    moved = both.where(f"of_with >= {toxicity.THRESHOLD} and of_without < {toxicity.THRESHOLD}").groupBy("lang").count()
    vile = spark.createDataFrame([(0, "en1 en2 vile en3")], "doc_id long, text string")
    return {r.lang: r["count"] for r in moved.collect()}, toxicity.scored(vile, model).first().score


def test_the_penalty_spares_neutral_mentions_in_each_language(spark):
    without, _ = neutral_mentions_flagged(spark, 0.0)
    with_default, vile = neutral_mentions_flagged(spark, None)
    print("flagged for the mention, of 25 a language: penalty 0:", without, "default:", with_default, "toxic word:", vile)
    assert all(without.get(lang, 0) >= 12 for lang in MENTIONS) and sum(with_default.values()) <= 2 and vile >= toxicity.THRESHOLD
