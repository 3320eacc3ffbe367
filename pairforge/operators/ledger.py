"""Requests that are asked once: a ledger of answers in the shared folder.

Requests are identified by what is asked (keys, messages, settings). Those that
the ledger answers are not asked again; the others are dealt to tasks, each of an
equal share of a lot, and a task's answers stand in the ledger as soon as it ends.
The tasks under way together hold about one lot. So a run that ends early, or a
lost executor, repeats about one lot at most, and a second run asks only what
failed or was never answered. All tasks are one Spark job: no lot waits for the
slowest request of another. The result is a table of its own: reading it twice
asks nothing.

Speculative execution would ask requests twice: leave it off for such jobs.

Defined cases: requests that are alike in all of that are asked once and share
the answer; a failed request is asked again by the next run, and the last error
stands until an answer comes; no requests, no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.indexing import written
from pairforge.operators.generate import KEY, complete, parse_responses, retry_failed
from pairforge.operators.planning import build_prompts

#: Requests under way whose answers are not committed yet, over all tasks.
LOT = 1_000
#: A task's file is handed over when the task ends, not with all others when the job does.
_BY_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}
_SCHEMA = "request_id string, attempt int, response string, error string"


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger's rows, or None where there is no ledger yet."""
    try:
        return spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as x:
        if "PATH_NOT_FOUND" in str(x):
            return None
        raise


def answers(rows: DataFrame) -> DataFrame:
    """(request_id, attempt, response, error): the answer to each request, else its last error."""
    best = F.max_by(F.struct("attempt", "response", "error"), F.struct(F.col("error").isNull(), "attempt"))
    return rows.groupBy("request_id").agg(best.alias("a")).select("request_id", "a.attempt", "a.response", "a.error")


def complete_once(requests: DataFrame, fn: Callable[[list, dict], str], ledger: str, keys: tuple[str, ...] = KEY, lot: int = LOT, concurrency: int | None = None) -> DataFrame:
    """``requests`` (keys, messages, temperature, max_tokens, …) without messages and with response and error, asked as the ledger at ``ledger`` leaves open."""
    spark = requests.sparkSession
    asked = F.sha2(F.to_json(F.struct(*keys, "messages", "temperature", "max_tokens")), 256)
    tagged = requests.withColumn("request_id", asked)
    known = _rows(spark, ledger)
    attempt = 1
    if known is not None:
        attempt += known.agg(F.max("attempt")).first()[0] or 0
        known = known.where("error is null").select("request_id")
    left = lambda df: df if known is None else df.join(known, "request_id", "left_anti")
    n = left(tagged.select("request_id")).count()
    at_once = concurrency or spark.sparkContext.defaultParallelism
    pieces = -(-n // max(1, lot // at_once))
    # as many tasks as may ask at once; without a bound of its own, Spark's cores are the bound
    rounds = -(-pieces // concurrency) if concurrency else min(1, pieces)
    for number in range(rounds):
        own = tagged.select("request_id", "messages", "temperature", "max_tokens").where(F.pmod(F.xxhash64("request_id"), F.lit(rounds)) == number)
        mine = left(own.repartition(concurrency or pieces, "request_id")).dropDuplicates(["request_id"])
        done = complete(mine, fn).select("request_id", F.lit(attempt).alias("attempt"), "response", "error")
        done.write.mode("append").options(**_BY_TASK).parquet(ledger)
    rows = _rows(spark, ledger)
    told = answers(rows if rows is not None else spark.createDataFrame([], _SCHEMA)).drop("attempt")
    # as the ledger stands now: a later run that adds to it doesn't change this result
    return written(tagged.drop("messages").join(told, "request_id", "left").drop("request_id"), "completed")


def recover(pairs: DataFrame, specs: DataFrame, failures: DataFrame, fn: Callable[[list, dict], str], ledger: str, keys: tuple[str, ...] = KEY, lot: int = LOT, **prompt) -> tuple[DataFrame, DataFrame]:
    """(pairs, still failing): the failed requests are asked again and the pairs they give are appended to ``pairs``.

    specs are those of the first run; columns of ``pairs`` that a reply does not give, like ratings, are null in what is appended.
    """
    again = build_prompts(written(retry_failed(specs, failures, keys), "again"), **prompt)
    got, still = parse_responses(complete_once(again.drop("text"), fn, ledger, keys, lot).select(*keys, "response", "error"))
    return pairs.unionByName(got, allowMissingColumns=True).select(*pairs.columns), still
