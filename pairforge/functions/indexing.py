"""Global dense row numbers without a single-task window."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Where none is named, a temporary one if all of Spark runs in this process, else ValueError.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Tables of at most this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: lineage is cut, and later readers read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, as the small side of a join: broadcast if its rows, at ``row_bytes`` each, keep within the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dense_index(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """Number the rows 0, 1, 2 … in ``order`` (ties in any order).

    Rows are range-partitioned and sorted, numbered inside each partition, and
    shifted by the row counts of the partitions before: one row for each
    partition is all that meets in one place.
    """
    at = F.col("_at")
    part, inside = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, inside + F.col("_before")).drop("_at", "_part", "_before")
