"""Text, tabular and markup files as documents."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.text import js_trim


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, size): each file a document, trimmed."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), js_trim(F.col("value")).alias("text"))
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1)).select("path", "name", "text", "size")


def _quoted_runs(plain: str) -> str:
    """A pattern for characters of the class ``plain`` and quoted sections, in any order; a quote that is never closed runs to the end."""
    return rf'{plain}*+(?:"[^"]*+(?:"|\z){plain}*+)*+'


def _cell(raw: Column) -> Column:
    """What a cell says: quoted sections without their quotes, doubled quotes as one, no carriage returns outside."""
    pieces = F.regexp_extract_all(raw, F.lit(r'(?s)"[^"]*+(?:""[^"]*+)*+(?:"|\z)|[^"]++'), 0)
    inner = lambda x: F.replace(F.regexp_extract(x, r'(?s)^"([^"]*+(?:""[^"]*+)*+)', 1), F.lit('""'), F.lit('"'))
    said = F.array_join(F.transform(pieces, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(F.translate(x, "\r", ""))), "")
    return F.when(raw.contains('"'), said).otherwise(F.translate(raw, "\r", ""))


def split_delimited(files: DataFrame, delimiter: str = ",") -> DataFrame:
    """(path, ord, cells): the rows of files (path, value), each with as many cells as it has; blank rows are left out.

    A file's text is cut into rows, and each row into cells, by patterns that know
    quotes: one pass, whatever the widths, and a row of its own for each line.
    """
    d = re.escape(delimiter)
    rows = F.regexp_extract_all("value", F.lit(rf'(?s){_quoted_runs("[^" + chr(34) + chr(92) + "n]")}(?:\n|\z)'), 0)
    line = F.regexp_replace("line", r"\n\z", "")
    each = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'(?s){d}({_quoted_runs("[^" + chr(34) + d + "]")})'), 1)
    cells = F.transform(each, _cell)
    out = files.select("path", F.posexplode(rows).alias("ord", "line")).select("path", F.col("ord").cast("long").alias("ord"), cells.alias("cells"))
    return out.where(F.exists("cells", lambda c: js_trim(c) != ""))


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, ord, cells) of delimited files, which are read whole (5 MiB is the limit of listings)."""
    return split_delimited(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), delimiter)


def is_header(cells: Column, n_rows: Column) -> Column:
    """A first row is a header if there are more rows, and all its cells are filled and none is a number."""
    return (n_rows >= 2) & F.forall(cells, lambda c: (js_trim(F.coalesce(c, F.lit(""))) != "") & ~js_trim(F.coalesce(c, F.lit(""))).rlike(r"^-?\d+(\.\d+)?$"))


@F.pandas_udf(T.StringType())
def _xml_text(xml: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return "".join(ET.fromstring(x or "").itertext())
        except ET.ParseError:
            return None

    return xml.map(one)


def xml_to_text(xml: Column) -> Column:
    """The text content with white space squeezed; null where the document is not well formed."""
    return F.trim(F.regexp_replace(_xml_text(xml), r"\s+", " "))


def delimited_documents(rows: DataFrame) -> DataFrame:
    """(path, text): the rows (path, ord, cells) of each file as one document of labelled records.

    The first row names the columns if it looks like a header (``is_header``);
    else, and for cells beyond it, the name is ``Column i``. Blank cells are left
    out. A file's records meet in one row, so files have to fit one (5 MiB is the
    limit of listings). A file of a header alone gives no document.
    """
    first = rows.groupBy("path").agg(F.min_by("cells", "ord").alias("first"), F.min("ord").alias("least"), F.count("*").alias("n_rows"))
    named = first.select("path", "least", F.when(is_header(F.col("first"), F.col("n_rows")), F.col("first")).alias("header"))
    own = rows.join(named, "path").where("header is null or ord > least")
    number = F.row_number().over(Window.partitionBy("path").orderBy("ord"))
    name = lambda i: F.coalesce(js_trim(F.get("header", i)), F.concat(F.lit("Column "), (i + 1).cast("string")))
    shown = F.transform("cells", lambda c, i: F.when(js_trim(c) != "", F.concat(name(i), F.lit(": "), js_trim(c))))
    record = F.concat_ws("\n", F.concat(F.lit("Record "), F.col("n").cast("string")), F.filter(shown, lambda x: x.isNotNull()))
    records = own.withColumn("n", number).select("path", F.struct("n", record.alias("text")).alias("r"))
    return records.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]), "\n\n").alias("text"))


def read_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, text): delimited files as documents of labelled records."""
    return delimited_documents(read_delimited(spark, path, delimiter))


def xml_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected with reject_reason) of files (text, …): the text of each, or that it is malformed or has none."""
    read = files.withColumn("text", xml_to_text(F.col("text")))
    reason = F.when(F.col("text").isNull(), "malformed").when(F.col("text") == "", "no text")
    seen = read.withColumn("reject_reason", reason)
    return seen.where("reject_reason is null").drop("reject_reason"), seen.where("reject_reason is not null").drop("text")
