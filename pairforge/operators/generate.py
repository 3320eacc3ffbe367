"""From requests to pairs: the completion hook, an offline generator, replies and retries."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.text import WHITE, js_trim, let
from pairforge.operators.planning import build_prompts

KEY = ("doc_id", "chunk_index", "voice_index")
#: The sentences of the offline generator.
QUESTION, TASK = 'What does the text say about "', 'Explain the following concept in simple terms: "'
CORE_IDEA = " This is a core idea that provides foundational context for understanding the broader topic."
#: How services word an overflow of the context.
OVERFLOW = ("context size", "context_length", "context length", "context window", "context has been exceeded", "maximum context", "input is too long", "too long for", "length exceeded")
OVERFLOW_WITH_TOKEN = ("exceed", "limit", "maximum", "too many")
NETWORK = ("Failed to fetch", "Network error", "ECONNREFUSED", "proxy_error", "HTTP 502")


def complete(specs: DataFrame, fn: Callable[[list, dict], str], concurrency: int | None = None) -> DataFrame:
    """Adds response and error: ``fn(messages, settings)`` for each request; a failure becomes its error row.

    ``concurrency`` bounds the requests under way at once. Write the result before reading it twice.
    """
    kept = [c for c in specs.columns if c not in ("messages",)]
    schema = ", ".join([*(f"{c} {t}" for c, t in specs.dtypes if c in kept), "response string", "error string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            response, error = [], []
            for messages, temperature, most in zip(b["messages"], b["temperature"], b["max_tokens"], strict=True):
                try:
                    response.append(fn([dict(m) if isinstance(m, dict) else m.asDict() for m in messages], {"temperature": temperature, "max_tokens": most}))
                    error.append(None)
                except Exception as x:  # one bad request never fails the batch
                    response.append(None)
                    error.append(str(x))
            yield b[kept].assign(response=response, error=error)

    spread = specs.repartition(concurrency) if concurrency else specs
    return spread.mapInPandas(run, schema)


def template_pairs(specs: DataFrame, styles: tuple[str, ...] = ("factual",)) -> DataFrame:
    """(key columns, item_index, instruction, output, type): deterministic pairs from the text of each request.

    Sentences of 20 characters or more are the pool if there are three; else groups of 12 words, else the text.
    """
    text = js_trim(F.coalesce("text", F.lit("")))
    long = lambda xs: F.filter(xs, lambda s: F.length(s) >= 20)
    sentences = lambda t: long(F.transform(F.split(t, f"(?<=[.!?]){WHITE}+"), js_trim))
    groups = lambda w: long(F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 12).cast("int")), lambda g: F.array_join(F.slice(w, g * 12 + 1, F.lit(12)), " ")))
    by_words = lambda t: let(let(F.split(t, f"{WHITE}+"), groups), lambda g: F.when(F.size(g) > 0, g).otherwise(F.array(t)))
    pool = let(text, lambda t: let(sentences(t), lambda s: F.when(F.size(s) >= 3, s).otherwise(by_words(t))))
    keys = [c for c in specs.columns if c != "text"]
    # each row of a request leaves with its own piece of text, not with the pool
    items = lambda xs, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("item_index"), F.element_at(xs, i % F.size(xs) + 1).alias("_x")))
    asked = specs.where("pairs > 0")
    picked = asked.select(*keys, F.inline(let(pool, lambda xs: items(xs, F.col("pairs")))))
    phrase = F.array_join(F.slice(F.split("_x", f"{WHITE}+", 6), 1, 5), " ")
    both = "instruction" in styles and "factual" in styles
    told = (F.col("item_index") % 3 == 2) if both else F.lit("instruction" in styles)
    question = F.concat(F.lit(QUESTION), phrase, F.lit('"?'))
    task = F.concat(F.lit(TASK), phrase, F.lit('..."'))
    return picked.select(
        *keys, "item_index", F.when(told, task).otherwise(question).alias("instruction"),
        F.when(told, F.concat("_x", F.lit(CORE_IDEA))).when(F.col("_x").endswith("."), F.col("_x")).otherwise(F.concat("_x", F.lit("."))).alias("output"),
        F.when(told, "instruction").otherwise("factual").alias("type"),
    )


def _bad_constant(name: str) -> None:
    raise ValueError(name)


def read_reply(raw: str | None) -> list[dict] | None:
    """The usable items of one reply, or None if no strategy reads it."""
    text = (raw or "").strip()
    bare = re.sub(r"\s*```\s*$", "", re.sub(r"^```(?:json)?\s*", "", text, count=1, flags=re.I), count=1).strip()
    tries = [text, bare]
    if 0 <= text.find("[") < text.rfind("]"):
        tries.append(text[text.find("[") : text.rfind("]") + 1])
    for t in tries:
        try:
            got = json.loads(t, parse_constant=_bad_constant)
        except (ValueError, RecursionError):
            continue
        if not isinstance(got, list) or any(x is None for x in got):
            continue
        pairs = [x for x in got if isinstance(x, dict) and isinstance(x.get("instruction"), str) and isinstance(x.get("output"), str)]
        return [{"instruction": x["instruction"], "output": x["output"], "type": "instruction" if x.get("type") == "instruction" else "factual"} for x in pairs]
    return None


_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in ("instruction", "output", "type")])


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("items", T.ArrayType(_ITEM))]))
def _replies(raw: pd.Series) -> pd.DataFrame:
    read = [read_reply(x) for x in raw]
    return pd.DataFrame({"ok": [r is not None for r in read], "items": [r or [] for r in read]})


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, failures): an item row for each usable object of a reply; unreadable replies and failed requests."""
    read = responses.withColumn("_r", _replies("response"))
    keys = [c for c in responses.columns if c not in ("response", "error", "text")]
    good = read.where("error is null and _r.ok").select(*keys, F.posexplode("_r.items").alias("item_index", "_i"))
    pairs = good.select(*keys, "item_index", "_i.instruction", "_i.output", "_i.type")
    failures = read.where("error is not null or not _r.ok").select(*keys, F.coalesce("error", F.lit("the reply is not a JSON array")).alias("error"), F.when(F.col("error").isNull(), F.col("response")).alias("raw_text"))
    return pairs, failures


def is_overflow(error: Column) -> Column:
    e = F.lower(F.coalesce(error, F.lit("")))
    some = lambda xs: F.greatest(*(e.contains(x) for x in xs))
    return some(OVERFLOW) | (e.contains("token") & some(OVERFLOW_WITH_TOKEN))


def classify_errors(error: Column, unreadable: Column | None = None) -> Column:
    """parse, network or api; ``unreadable`` tells errors of reading a reply."""
    network = F.greatest(*(F.coalesce(error, F.lit("")).contains(x) for x in NETWORK))
    return F.when(F.lit(False) if unreadable is None else unreadable, "parse").when(network, "network").otherwise("api")


def shrink_retry(specs: DataFrame, fn: Callable[[list, dict], str], retries: int = 3, **prompt) -> DataFrame:
    """Responses; a request that overflows the context is asked again with half its text and pairs."""
    from pairforge.functions.indexing import durable

    waiting, done = specs, None
    for attempt in range(retries + 1):
        now = durable(complete(build_prompts(waiting, **prompt), fn))
        again = is_overflow(F.col("error")) & (F.length("text") > 500) if attempt < retries else F.lit(False)
        settled = now.where(~F.coalesce(again, F.lit(False)))
        done = settled if done is None else done.unionByName(settled)
        waiting = now.where(again).withColumn("text", F.substring("text", 1, 2147483647).substr(F.lit(1), F.ceil(F.length("text") / 2).cast("int"))).withColumn("pairs", F.greatest(F.lit(1), F.ceil(F.col("pairs") / 2)).cast("int")).select(*specs.columns)
        if attempt == retries or not waiting.head(1):
            break
    return done


def retry_failed(specs: DataFrame, failures: DataFrame, keys: tuple[str, ...] = KEY) -> DataFrame:
    """The requests that failed, to be run again."""
    return specs.join(failures.select(*keys), list(keys), "left_semi")


def regenerate_pairs(pairs: DataFrame, ids: DataFrame, docs: DataFrame, fn: Callable[[list, dict], str], difficulty: str = "intermediate") -> DataFrame:
    """Pairs with those of ``ids`` rewritten from their document's first chunk; rating and edits are cleared."""
    from pairforge.functions.indexing import durable
    from pairforge.operators.chunking import chunk_documents

    own = pairs.join(ids.select("id"), "id", "left_semi").select("id", "doc_id", "type")
    first = chunk_documents(docs.select("doc_id", "text")).where("index = 0").select("doc_id", "text", "index", "total")
    out = None
    for style in ("factual", "instruction"):
        specs = own.where(F.col("type") == style).join(first, "doc_id").withColumn("pairs", F.lit(1))
        got, _ = parse_responses(durable(complete(build_prompts(specs, [style], difficulty), fn).drop("type")))  # asked once, however often it is read
        got = got.where("item_index = 0").select("id", F.col("instruction").alias("_i"), F.col("output").alias("_o"), F.col("type").alias("_y"))
        out = got if out is None else out.unionByName(got)
    joined = pairs.join(out, "id", "left")
    new = F.col("_i").isNotNull()
    values = {"instruction": F.coalesce("_i", "instruction"), "output": F.coalesce("_o", "output"), "type": F.coalesce("_y", "type"), "rating": F.when(~new, F.col("rating")), "edited": F.when(new, False).otherwise(F.col("edited"))}
    return joined.select(*(values[c].alias(c) if c in values else c for c in pairs.columns))
