"""Inputs of the registered queries, derived from the given tables, with the SQL that derives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.operators.chunking import chunk_documents
from pairforge.operators.generate import template_pairs
from pairforge.operators.planning import build_specs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    ident = F.col("conv_id") * 1000 + F.col("turn")
    kind = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, "instruction").when(F.col("conv_id") % 50 == 7, "other").otherwise("factual")
    rating = F.when(ident % 3 == 0, "up").when(ident % 3 == 1, "down")
    persona = F.when(F.col("conv_id") % 4 == 1, "novice").when(F.col("conv_id") % 4 == 2, "auditor")
    return u.join(a, ["conv_id", "turn"]).select(ident.alias("id"), ident.alias("ord"), "instruction", "output", kind.alias("type"), rating.alias("rating"), F.lit(False).alias("edited"), persona.alias("persona_id"), F.initcap(persona).alias("persona_name"))


PAIRS_SQL = """p AS (
  SELECT u.conv_id * 1000 + u.turn AS id, u.text AS instruction, a.text AS output,
         CASE WHEN (u.conv_id + u.turn) % 3 = 0 THEN 'instruction' WHEN u.conv_id % 50 = 7 THEN 'other' ELSE 'factual' END AS type,
         CASE (u.conv_id * 1000 + u.turn) % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' END AS rating, false AS edited,
         CASE u.conv_id % 4 WHEN 1 THEN 'novice' WHEN 2 THEN 'auditor' END AS persona_id
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')"""


def specs(spark: SparkSession, sf_dir: str, pair_count: int = 10) -> DataFrame:
    chunks = chunk_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return build_specs(chunks, pair_count).withColumnRenamed("index", "chunk_index")


def document_pairs(spark: SparkSession, sf_dir: str, styles: tuple[str, ...] = ("factual", "instruction")) -> DataFrame:
    out = template_pairs(specs(spark, sf_dir).select("doc_id", "lang", "chunk_index", "voice_index", "pairs", "text"), styles)
    return out.withColumn("id", F.concat_ws("/", *(F.format_string("%012d", F.col(c).cast("long")) for c in ("doc_id", "chunk_index", "item_index"))))


def _cut(mark: str, width: int) -> str:
    s = f"substr(text, st + 3201, {width})"
    return f"CASE WHEN strpos(reverse({s}), reverse({mark})) > 0 THEN st + 3200 + length({s}) - strpos(reverse({s}), reverse({mark})) + 1 END"


_MARKS = ["chr(10) || chr(10)", "'. '", "'! '", "'? '", "'.' || chr(10)", "'!' || chr(10)", "'?' || chr(10)"]
_BREAK = "coalesce(" + ", ".join([*(_cut(m, 802) for m in _MARKS), _cut("' '", 801), "st + 4000"]) + ")"
CHUNKS_SQL = f"""w(doc_id, lang, text, index, st, fin) AS (
  SELECT doc_id, lang, coalesce(text, ''), 0, 0, CASE WHEN length(coalesce(text, '')) <= 4000 THEN length(coalesce(text, '')) ELSE (SELECT {_BREAK.replace(' st ', ' 0 ').replace('st +', '0 +')}) END FROM documents
  UNION ALL
  SELECT doc_id, lang, text, index + 1, st, CASE WHEN st + 4000 >= length(text) THEN length(text) ELSE {_BREAK} END
  FROM (SELECT doc_id, lang, text, index, greatest(st + 1, fin - 300) AS st, fin FROM w WHERE fin < length(text))),
k AS (SELECT doc_id, lang, index, st AS start, fin AS "end", substr(text, st + 1, fin - st) AS text, count(*) OVER (PARTITION BY doc_id) AS total FROM w)"""
SPECS_SQL = """s AS (SELECT doc_id, lang, index, total AS n_chunks_raw, least(total, 10) AS total, 10 // least(total, 10) + CASE WHEN index < 10 % least(total, 10) THEN 1 ELSE 0 END AS pairs, text
  FROM k WHERE index < 10)"""
_W = r"[\s\x{00a0}\x{feff}]"
DOC_PAIRS_SQL = rf"""t AS (SELECT *, regexp_replace(text, '^{_W}+|{_W}+$', '', 'g') AS x FROM s),
b AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(x, '([.!?]){_W}+', '\1' || chr(1), 'g'), chr(1)), lambda y: regexp_replace(y, '^{_W}+|{_W}+$', '', 'g')), lambda y: length(y) >= 20) AS sen,
       regexp_split_to_array(x, '{_W}+') AS wd FROM t),
g AS (SELECT *, CASE WHEN len(sen) >= 3 THEN sen ELSE list_filter(list_transform(range(0, (len(wd) - 1) // 12 + 1), lambda n: array_to_string(wd[n * 12 + 1:n * 12 + 12], ' ')), lambda y: length(y) >= 20) END AS pool FROM b),
i AS (SELECT doc_id, lang, index AS chunk_index, item_index, CASE WHEN len(pool) = 0 THEN x ELSE pool[item_index % len(pool) + 1] END AS y FROM g, unnest(range(0, pairs)) AS u(item_index)),
q AS (SELECT *, array_to_string(regexp_split_to_array(y, '{_W}+')[1:5], ' ') AS phrase, item_index % 3 = 2 AS task FROM i),
dp AS (SELECT doc_id, lang, chunk_index, item_index,
       CASE WHEN task THEN 'Explain the following concept in simple terms: "' || phrase || '..."' ELSE 'What does the text say about "' || phrase || '"?' END AS instruction,
       CASE WHEN task THEN y || ' This is a core idea that provides foundational context for understanding the broader topic.' WHEN y LIKE '%.' THEN y ELSE y || '.' END AS output,
       CASE WHEN task THEN 'instruction' ELSE 'factual' END AS type FROM q)"""
ALL_SQL = f"WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL}, {DOC_PAIRS_SQL}"
