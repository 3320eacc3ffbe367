"""Requests are asked once, over failures, second runs and batches that are played again."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from pairforge.operators import generate, ledger, planning
from pairforge.streaming import generate as stream


def requests(spark, n=40):
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit(0).alias("voice_index"), F.lit(1).alias("pairs"), F.lit(0).alias("index"), F.lit(1).alias("total"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    return planning.build_prompts(rows, ["factual"])


def told(path, then):
    """A service that notes each call in a file, which the test counts."""

    def service(messages, settings):
        text = messages[1]["content"].split("EXCERPT:\n")[1].split("\n")[0]
        with open(path, "a") as f:
            f.write(text + "\n")
        return then(text)

    return service


def calls(path):
    return collections.Counter(open(path).read().splitlines()) if os.path.exists(path) else collections.Counter()


def answering():
    """Made inside a function, so that workers need not import this module."""
    return lambda text: f'[{{"instruction": "What is in {text}?", "output": "It is {text}."}}]'


def test_only_failures_are_asked_again_and_their_pairs_appended(spark, tmp_path):
    log, book, answer = str(tmp_path / "calls"), str(tmp_path / "ledger"), answering()

    def shaky(text):
        if text.endswith("7"):
            raise ValueError("HTTP 502")
        return answer(text)

    rows = requests(spark)
    first = ledger.complete_once(rows, told(log, shaky), book, lot=9)
    assert first.count() == 40 and first.where("error is not null").count() == 4
    assert set(calls(log).values()) == {1}  # reading the result twice asked nothing
    pairs, failures = generate.parse_responses(first.select(*generate.KEY, "response", "error"))
    pairs = pairs.withColumn("rating", F.lit("up"))
    whole, still = ledger.recover(pairs, rows.drop("messages", "temperature", "max_tokens"), failures, told(log, answering()), book, styles=["factual"])
    assert whole.count() == 40 and still.count() == 0 and whole.where("rating is null").count() == 4
    assert calls(log) == {f"text {i}": 2 if str(i).endswith("7") else 1 for i in range(40)}
    again = ledger.complete_once(rows, told(log, answering()), book)
    assert again.where("error is null").count() == 40 and sum(calls(log).values()) == 44


def test_a_lost_worker_repeats_one_lot_at_most(spark, tmp_path):
    log, book, bad = str(tmp_path / "calls"), str(tmp_path / "ledger"), str(tmp_path / "ill")
    open(bad, "w").close()
    answer = answering()

    def dying(text):
        import os

        if len(open(log).read().splitlines()) > 25 and os.path.exists(bad):
            os._exit(1)  # the worker goes with all it had under way
        return answer(text)

    with pytest.raises(Exception):
        ledger.complete_once(requests(spark), told(log, dying), book, lot=8)
    os.remove(bad)
    before = sum(calls(log).values())
    assert 0 < before < 40
    done = ledger.complete_once(requests(spark), told(log, dying), book, lot=8)
    assert done.where("error is null").count() == 40
    n = calls(log)
    assert set(n) == {f"text {i}" for i in range(40)} and sum(n.values()) - 40 <= 20 and sum(v == 1 for v in n.values()) >= 20


def test_requests_that_are_alike_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "calls")
    rows = requests(spark, 3)
    twice = rows.union(rows)
    assert ledger.complete_once(twice, told(log, answering()), str(tmp_path / "b")).where("response is not null").count() == 6
    assert sum(calls(log).values()) == 3
    assert ledger.complete_once(rows.limit(0), told(log, answering()), str(tmp_path / "none")).count() == 0


def test_a_batch_that_is_played_again_changes_nothing(spark, tmp_path, monkeypatch):
    log, out = str(tmp_path / "calls"), str(tmp_path / "out")
    for i in range(3):
        spark.range(i * 4, i * 4 + 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream.stream_generate(spark, str(tmp_path / "in"), out, str(tmp_path / "check"), pair_count=1, fn=told(log, answering()), files_a_batch=1).awaitTermination(300)

    real, seen = stream._counted, []

    def failing(df, name, *rest, **counts):
        told_ = real(df, name, *rest, **counts)
        seen.append(name)
        if seen == ["pairs", "failures", "pairs"]:  # the second batch has written its pairs, but is not done
            raise RuntimeError("the driver is lost")
        return told_

    monkeypatch.setattr(stream, "_counted", failing)
    with pytest.raises(Exception):
        run()
    assert stream.progress(spark, out).count() == 1
    run()
    got = stream.read_pairs(spark, out)
    assert got.count() == 12 and got.select("doc_id").distinct().count() == 12 and got.select("batch").distinct().count() == 3
    assert [(r.n_pairs, r.n_failed, r.pairs_so_far) for r in stream.progress(spark, out).orderBy("batch").collect()] == [(4, 0, 4), (4, 0, 8), (4, 0, 12)]
    assert set(calls(log).values()) == {1}


def test_jobs_do_not_grow_with_the_requests(spark, tmp_path):
    """Lots are tasks of one job; a bound on requests under way is kept by rounds of so many tasks."""

    def jobs(lot, concurrency=None):
        name, log = f"lot-{lot}-{concurrency}", str(tmp_path / f"calls-{lot}-{concurrency}")
        spark.sparkContext.setJobGroup(name, name)
        try:
            done = ledger.complete_once(requests(spark), told(log, answering()), str(tmp_path / name), lot=lot, concurrency=concurrency)
            n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        finally:
            spark.sparkContext._jsc.clearJobGroup()
        assert done.where("response is not null").count() == 40 and set(calls(log).values()) == {1} and len(calls(log)) == 40
        return n

    assert jobs(4) == jobs(40)
    assert jobs(20, 2) < jobs(4, 2)
