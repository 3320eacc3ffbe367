"""What a run will cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.chunking import chunk_documents

#: US dollars for a million tokens in and out, by a part of the model's name.
PRICES = (
    ("claude-opus-4", 15.0, 75.0), ("claude-sonnet-4", 3.0, 15.0), ("claude-haiku-4", 1.0, 5.0), ("claude-3-5-sonnet", 3.0, 15.0), ("claude-3-5-haiku", 0.8, 4.0),
    ("claude-3-opus", 15.0, 75.0), ("claude-3-haiku", 0.25, 1.25), ("gpt-4o-mini", 0.15, 0.6), ("gpt-4o", 2.5, 10.0), ("gpt-4-turbo", 10.0, 30.0), ("gpt-4", 30.0, 60.0),
    ("gpt-3.5-turbo", 0.5, 1.5), ("o3-mini", 1.1, 4.4), ("o1-mini", 1.1, 4.4), ("o1", 15.0, 60.0), ("gemini-2.0-flash", 0.1, 0.4), ("gemini-1.5-flash", 0.075, 0.3),
    ("gemini-1.5-pro", 1.25, 5.0), ("gemini", 0.5, 1.5), ("llama-3.3-70b", 0.88, 0.88), ("llama-3.1-405b", 3.5, 3.5), ("llama-3.1-70b", 0.88, 0.88), ("llama-3.1-8b", 0.18, 0.18),
    ("llama", 0.9, 0.9), ("deepseek-chat", 0.27, 1.1), ("deepseek-reasoner", 0.55, 2.19), ("deepseek", 0.27, 1.1), ("qwen-max", 1.6, 6.4), ("qwen-plus", 0.4, 1.2), ("qwen", 0.4, 1.2),
)
FREE_PROVIDERS = ("ollama", "mock")
PROMPT_CHARS, PAIR_CHARS, REQUEST_SECONDS, WARN_USD = 1200, 500, 6, 5


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "key string, price_in double, price_out double")


def price_lookup(runs: DataFrame) -> DataFrame:
    """Adds price_in and price_out to runs (provider, model): the longest key contained in the model's name; null if none is."""
    table = F.broadcast(prices(runs.sparkSession))  # thirty rows
    named = runs.select("provider", "model").distinct()
    best = named.join(table, F.lower(F.coalesce("model", F.lit(""))).contains(F.col("key")), "left").groupBy("provider", "model").agg(*(F.max_by(c, F.length("key")).alias(f"_{c}") for c in ("price_in", "price_out")))
    best = best.withColumnsRenamed({"provider": "_provider", "model": "_model"})
    on = F.col("provider").eqNullSafe(F.col("_provider")) & F.col("model").eqNullSafe(F.col("_model"))
    free = F.col("provider").isin(*FREE_PROVIDERS)
    return runs.join(best, on, "left").select(*runs.columns, *(F.when(free, 0.0).otherwise(F.col(f"_{c}")).alias(c) for c in ("price_in", "price_out")))


def _tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def estimate_run(docs: DataFrame, pair_count: int, n_voices: int, concurrency: int, provider: str, model: str) -> DataFrame:
    """One row: requests, pairs, tokens in and out, cost (null if the price is unknown) and seconds, from the real chunks of docs (doc_id, text)."""
    voices = max(1, n_voices)
    chunks = chunk_documents(docs.select("doc_id", "text")).where(F.col("index") < max(1, pair_count // voices))
    total = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("index") == 0).alias("docs"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("chars"))
    priced = price_lookup(total.withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model)))
    tokens_in, tokens_out = _tokens((F.col("chars") + F.col("chunks") * PROMPT_CHARS) * voices), _tokens(F.col("docs") * (pair_count * PAIR_CHARS))
    return priced.select(
        (F.col("chunks") * voices).alias("requests"), (F.col("docs") * pair_count).alias("pairs"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"),
        (tokens_in / 1e6 * F.col("price_in") + tokens_out / 1e6 * F.col("price_out")).alias("cost_usd"), F.ceil(F.col("chunks") * voices / max(1, concurrency) * REQUEST_SECONDS).cast("long").alias("seconds"),
    )


def estimate_from_listing(listing: DataFrame, pair_count: int, concurrency: int, provider: str, model: str) -> DataFrame:
    """The same from sizes alone; warn: the cost reaches 5 US dollars."""
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("docs"))
    per = F.least(F.lit(pair_count), F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.greatest("docs", F.lit(1)) / 3700)))
    priced = price_lookup(total.withColumn("chunks", F.col("docs") * per).withColumn("provider", F.lit(provider)).withColumn("model", F.lit(model)))
    tokens_in, tokens_out = _tokens(F.col("bytes") + F.col("chunks") * PROMPT_CHARS), _tokens(F.col("docs") * (pair_count * PAIR_CHARS))
    cost = (tokens_in * F.col("price_in") + tokens_out * F.col("price_out")) / 1e6
    return priced.select(F.col("chunks").cast("long").alias("requests"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), cost.alias("cost_usd"), F.coalesce(cost >= WARN_USD, F.lit(False)).alias("warn"), F.ceil(F.col("chunks") / concurrency * REQUEST_SECONDS).cast("long").alias("seconds"))
