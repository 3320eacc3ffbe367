"""Flags for pairs that would hurt a fine-tune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairforge.functions.text import js_trim

MIN_INSTRUCTION, MIN_OUTPUT, MAX_OUTPUT, TRUNCATED_FROM = 10, 20, 6000, 40
#: Phrases that refer to the source.
LEAKS = (
    r"according to the (document|text|excerpt|passage|article)",
    r"as (stated|mentioned|described|noted) in the (document|text|excerpt|passage)",
    r"the (document|text|excerpt|passage) (states|says|mentions|describes|notes)",
    r"based on the (provided )?(document|text|excerpt|passage)",
    r"in this (document|excerpt|passage)",
)


def _issue(when: Column, code: str, severity: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message")))


def validate_pairs(pairs: DataFrame) -> DataFrame:
    """Adds issues: the ordered array of (code, severity, message) of each pair."""
    i, o = js_trim(F.coalesce("instruction", F.lit(""))), js_trim(F.coalesce("output", F.lit("")))
    leak = o.rlike("(?i)" + "|".join(f"(?:{p})" for p in LEAKS))
    n_i, n_o = F.length(i), F.length(o)
    found = F.array(
        _issue(n_i == 0, "empty_instruction", "error", "no instruction"),
        _issue((n_i > 0) & (n_i < MIN_INSTRUCTION), "short_instruction", "error", F.format_string("the instruction has just %d characters", n_i)),
        _issue(n_o == 0, "empty_output", "error", "no output"),
        _issue((n_o > 0) & (n_o < MIN_OUTPUT), "short_output", "error", F.format_string("the output has just %d characters", n_o)),
        _issue((n_o >= TRUNCATED_FROM) & ~o.rlike("[.!?\"')\\]}…]\\z"), "truncated_output", "error", "the output ends without closing punctuation"),
        _issue(leak, "source_leak", "warn", "the output speaks of its source"),
        _issue(n_o > MAX_OUTPUT, "long_output", "warn", F.format_string("the output has %,d characters", n_o)),
        _issue((F.col("type") == "factual") & (n_i > 0) & ~i.contains("?"), "factual_no_question", "warn", "a factual instruction that asks no question"),
        _issue((n_i > 0) & (n_o > 0) & (F.lower(i) == F.lower(o)), "echo", "warn", "the output repeats the instruction"),
        _issue((F.col("type") != "") & ~F.col("type").isin("factual", "instruction"), "bad_type", "warn", F.format_string('unknown type "%s"', "type")),
    )
    return pairs.withColumn("issues", F.filter(found, lambda x: x.isNotNull()))


def _summary() -> list[Column]:
    error = F.exists("issues", lambda x: x["severity"] == "error")
    some = F.size("issues") > 0
    return [F.count_if(error).alias("error_count"), F.count_if(some & ~error).alias("warn_count"), F.count_if(some).alias("flagged_count")]


def quality_summary(validated: DataFrame) -> DataFrame:
    """One row: error_count, warn_count (warnings only), flagged_count."""
    return validated.agg(*_summary())


def with_summary(validated: DataFrame) -> tuple[DataFrame, Observation]:
    """``validated`` and the summary that fills while it is written or counted: no scan of its own."""
    seen = Observation()
    return validated.observe(seen, *_summary()), seen
