"""Pairs as documents arrive: a file stream in, files of pairs out, each input file handled once.

Each batch is written under its own number (``pairs/batch=7``, ``failures/batch=7``,
``counts/batch=7``), and replaces what an earlier try of that batch has left. So a
batch that is played again after a failure changes nothing, and its requests to a
service are answered from the ledger beside the pairs, not asked again. The counts
of each batch are observed while its pairs are written: nothing is read twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from pairforge.functions.indexing import written
from pairforge.operators.chunking import chunk_documents
from pairforge.operators.generate import KEY, parse_responses, template_pairs
from pairforge.operators.ledger import LOT, complete_once
from pairforge.operators.planning import build_prompts, build_specs
from pairforge.operators.quality import validate_pairs

PAIR_SCHEMA = "doc_id long, chunk_index int, voice_index int, item_index int, instruction string, output string, type string, issues array<struct<code:string,severity:string,message:string>>"
FAILURE_SCHEMA = "doc_id long, chunk_index int, voice_index int, error string, raw_text string"
COUNTS = ("n_pairs", "n_flagged", "n_failed")


def specs_of(docs: DataFrame, pair_count: int = 10) -> DataFrame:
    """Requests of documents (doc_id, text): chunk and plan, without state, so it serves a batch and a stream alike."""
    return build_specs(chunk_documents(docs.select("doc_id", "text")), pair_count).withColumn("chunk_index", F.col("index"))


def pairs_of(docs: DataFrame, pair_count: int = 10) -> DataFrame:
    """Flagged pairs of the offline generator."""
    return validate_pairs(template_pairs(specs_of(docs, pair_count).select(*KEY, "pairs", "text")).drop("pairs"))


def _counted(df: DataFrame, name: str, out_dir: str, batch: str, **counts) -> dict[str, int]:
    """Writes ``df`` as JSON lines under the batch's number and returns the counts observed on the way."""
    seen = Observation()
    df.observe(seen, *(c.alias(n) for n, c in counts.items())).write.mode("overwrite").json(f"{out_dir}/{name}/{batch}")
    return {n: int(seen.get[n] or 0) for n in counts}


def stream_generate(
    spark: SparkSession,
    input_dir: str,
    out_dir: str,
    checkpoint: str,
    pair_count: int = 10,
    fn: Callable[[list, dict], str] | None = None,
    files_a_batch: int | None = None,
    lot: int = LOT,
    **prompt,
):
    """Start the query over the Parquet files (doc_id, text) of ``input_dir``; it ends when all present files are done.

    fn: the service that answers requests, else the offline generator; prompt: styles and so on, see ``build_prompts``.
    """
    reader = spark.readStream.schema("doc_id long, text string")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)

    def handle(docs: DataFrame, number: int) -> None:
        batch = f"batch={number}"
        if fn is None:
            pairs, failures = pairs_of(docs, pair_count), None
        else:
            requests = build_prompts(written(specs_of(docs, pair_count), "specs"), **({"styles": ["factual"]} | prompt))
            told = complete_once(requests.drop("text"), fn, f"{out_dir}/requests", lot=lot)
            got, failures = parse_responses(told.select(*KEY, "response", "error"))
            pairs = validate_pairs(got)
        counts = _counted(pairs, "pairs", out_dir, batch, n_pairs=F.count("*"), n_flagged=F.count_if(F.size("issues") > 0))
        counts |= _counted(failures, "failures", out_dir, batch, n_failed=F.count("*")) if failures is not None else {"n_failed": 0}
        one = docs.sparkSession.range(1).select(*(F.lit(counts[c]).cast("long").alias(c) for c in COUNTS))
        one.write.mode("overwrite").parquet(f"{out_dir}/counts/{batch}")  # last: a batch that has counts is whole

    return reader.parquet(input_dir).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pairs(spark: SparkSession, out_dir: str) -> DataFrame:
    """The pairs written so far, with their batch."""
    return spark.read.schema(f"{PAIR_SCHEMA}, batch long").json(f"{out_dir}/pairs")


def read_failures(spark: SparkSession, out_dir: str) -> DataFrame:
    """The requests that failed, with their batch; what ``ledger.recover`` takes."""
    return spark.read.schema(f"{FAILURE_SCHEMA}, batch long").json(f"{out_dir}/failures")


def progress(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch, n_pairs, n_flagged, n_failed, pairs_so_far): a row for each finished batch."""
    counts = spark.read.schema(", ".join(f"{c} long" for c in COUNTS) + ", batch long").parquet(f"{out_dir}/counts")
    so_far = F.sum("n_pairs").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))  # one row a batch
    return counts.select("batch", *COUNTS, so_far.alias("pairs_so_far"))
