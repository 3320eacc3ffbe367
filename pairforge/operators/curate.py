"""Filtering, editing and summing up pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairforge.functions.text import half_up


def filter_pairs(pairs: DataFrame, type: str | None = None, persona: str | None = None, status: str | None = None, query: str | None = None, flagged: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    """persona 'none' keeps pairs without one; status: up, down, unrated, edited, flagged or duplicate."""
    out = pairs
    if type:
        out = out.where(F.col("type") == type)
    if persona:
        out = out.where(F.col("persona_id").isNull() if persona == "none" else F.col("persona_id") == persona)
    if status in ("up", "down"):
        out = out.where(F.col("rating") == status)
    elif status == "unrated":
        out = out.where("rating is null")
    elif status == "edited":
        out = out.where("edited")
    elif status == "flagged":
        out = out.join(flagged.select("id"), "id", "left_semi")
    elif status == "duplicate":
        out = out.join(duplicates.select(F.col("dup_id").alias("id")), "id", "left_semi")
    if query:
        text = F.lower(F.concat(F.coalesce("instruction", F.lit("")), F.lit(" "), F.coalesce("output", F.lit(""))))
        out = out.where(text.contains(query.lower()))
    return out


def upsert_pairs(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """``pairs`` with ``changes`` applied by id: (id, any of the pairs' columns, and two that may be left out).

    fields: names of the columns that a change gives, so that null can be given, too (a
    cleared rating); where it is null or left out, what is not null is given. seq: the
    order of changes to one id; of each field the last given value stays. Any change sets
    edited, unless it gives edited itself. Ids that no pair has change nothing.

    Changes of one id meet in an aggregation with one value a field, however many they
    are, so each pair stays one row.
    """
    given = [c for c in changes.columns if c in pairs.columns and c != "id"]
    order = F.coalesce("seq", F.lit(-1)) if "seq" in changes.columns else F.lit(0)
    has = lambda c: F.coalesce(F.array_contains("fields", c), F.col(c).isNotNull()) if "fields" in changes.columns else F.col(c).isNotNull()
    last = (F.max_by(F.struct(F.col(c).alias("v")), F.when(has(c), order)).alias(f"_{c}") for c in given)
    merged = changes.where("id is not null").groupBy("id").agg(*last, F.lit(True).alias("_changed"))
    joined = pairs.join(merged, "id", "left")
    new = {c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in given}
    touched = F.when(F.col("_changed"), True).otherwise(F.col("edited"))
    new["edited"] = F.when(F.col("_edited").isNotNull(), F.col("_edited.v")).otherwise(touched) if "edited" in given else touched
    return joined.select(*(new[c].alias(c) if c in new else c for c in pairs.columns))


def delete_pairs(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    return pairs.join(ids.select("id"), "id", "left_anti")


def append_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out


def replace_documents(pairs: DataFrame, final: DataFrame) -> DataFrame:
    """The final pairs of documents take the place of those streamed before."""
    return pairs.join(final.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(final)


def order_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy("doc_id", "chunk_index", "voice_index", "item_index")


def _stats(validation_ratio: float) -> list[Column]:
    chars = F.coalesce(F.sum(F.length(F.coalesce("instruction", F.lit(""))) + F.length(F.coalesce("output", F.lit("")))), F.lit(0))
    n = F.count("*")
    val = F.lit(0) if validation_ratio <= 0 else n if validation_ratio >= 1 else F.when(n > 0, F.greatest(F.lit(1), half_up(n * validation_ratio))).otherwise(0)
    return [
        F.count_if(F.col("type") == "factual").alias("factual"), F.count_if(F.col("type") == "instruction").alias("instruction"),
        half_up(chars / 4).cast("long").alias("tokens"), (n - val).cast("long").alias("train"), val.cast("long").alias("val"),
    ]


def dataset_stats(pairs: DataFrame, validation_ratio: float = 0.0) -> DataFrame:
    """One row: counts by type, estimated tokens, sizes of both splits."""
    return pairs.agg(*_stats(validation_ratio))


def with_stats(pairs: DataFrame, validation_ratio: float = 0.0) -> tuple[DataFrame, Observation]:
    """``pairs`` and the same numbers, which fill while they are written or counted: no scan of their own."""
    seen = Observation()
    return pairs.observe(seen, *_stats(validation_ratio)), seen


def personas_present(pairs: DataFrame) -> DataFrame:
    return pairs.where("persona_id is not null").select("persona_id", "persona_name").distinct()
