"""Shapes and files of finished datasets, with a reproducible split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.indexing import dense_index


def _message(**fields: Column | str) -> Column:
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()))


def shape(schema: str) -> list[Column]:
    i, o = F.col("instruction"), F.col("output")
    if schema == "chatml":
        return [F.array(_message(role="user", content=i), _message(role="assistant", content=o)).alias("messages")]
    if schema == "alpaca":
        return [i, F.lit("").alias("input"), o]
    if schema == "sharegpt":
        return [F.array(_message(**{"from": "human", "value": i}), _message(**{"from": "gpt", "value": o})).alias("conversations")]
    return [i, o, F.col("type")]


def to_schema(pairs: DataFrame, schema: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """instruction, chatml, alpaca or sharegpt; anything else counts as instruction. keys: columns kept besides."""
    return pairs.select(*keys, *shape(schema))


def _cell(c: str) -> Column:
    text = F.coalesce(F.col(c), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def serialize(pairs: DataFrame, format: str = "jsonl", schema: str = "instruction", keys: tuple[str, ...] = ()) -> DataFrame:
    """A line for each pair: a JSON object of the schema, or the flat CSV form."""
    if format == "csv":
        return pairs.select(*keys, F.concat_ws(",", *map(_cell, ("instruction", "output", "type"))).alias("line"))
    return pairs.select(*keys, F.to_json(F.struct(*shape(schema)), {"ignoreNullFields": "false"}).alias("line"))


def split_train_val(pairs: DataFrame, ratio: float, order: list[str]) -> DataFrame:
    """Adds split ('train' or 'val'): evenly spaced validation rows in ``order``."""
    if ratio <= 0 or ratio >= 1:
        return pairs.withColumn("split", F.lit("train" if ratio <= 0 else "val"))
    indexed = dense_index(pairs, order, "_i")
    n = indexed.count()
    if not n:
        return pairs.withColumn("split", F.lit("train"))
    count = max(1, int(n * ratio + 0.5))
    stride = n / count
    # the k-th validation row is at floor(k * stride + stride / 2): ask which k could give this row
    k = F.floor((F.col("_i") - stride / 2) / stride)
    at = lambda d: F.least(F.lit(n - 1), F.floor((k + d) * stride + stride / 2))
    hit = F.lit(False)
    for d in (-1, 0, 1, 2):
        hit = hit | ((at(d) == F.col("_i")) & (k + d >= 0) & (k + d < count))
    return indexed.withColumn("split", F.when(hit, "val").otherwise("train")).drop("_i")


def write_dataset(pairs: DataFrame, path: str, format: str = "jsonl", schema: str = "instruction", validation_ratio: float = 0.0, order: list[str] | None = None) -> dict[str, int]:
    """Writes ``path``, or ``path``_train and ``path``_val, and returns the rows of each."""
    order = order or ["id"]
    split = split_train_val(pairs, validation_ratio, order)
    out = {}
    for name in ("train", "val") if validation_ratio > 0 else ("train",):
        own = split.where(F.col("split") == name).drop("split") if validation_ratio > 0 else pairs
        to = f"{path}_{name}" if validation_ratio > 0 else path
        ranged = own.repartitionByRange(*order).sortWithinPartitions(*order)
        if format == "csv":
            ranged.select("instruction", "output", "type").write.mode("overwrite").csv(to, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            out[name] = own.count()
        else:
            to_schema(ranged, schema).write.mode("overwrite").json(to, ignoreNullFields=False)
            out[name] = own.count()
    return out
