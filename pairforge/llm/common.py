"""Shared helpers: durable intermediate tables, folds and hygiene of input columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables of at most this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by ``spark.checkpoint.dir``.

    Where none is named, a temporary one if all of Spark runs in this process, else ValueError.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Fold of evaluation: crc32 of the id as text, modulo 3, is 1; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, a written table, as the small side of a join: broadcast if its rows, at ``row_bytes`` each, keep within the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def positional(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1 …, which clash with no name of ours, and the new name of each column."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new, strict=True))


def drawn(df: DataFrame, h: str, rate: Column) -> DataFrame:
    """The rows whose 64-bit hash ``h`` falls under ``rate``, a share from 0 to 1 (all rows from 1 on)."""
    return df.where((rate >= 1) | (F.col(h).cast("double") < rate * 2.0**64 - 2.0**63))
