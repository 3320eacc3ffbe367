r"""Chat formatting with typed content parts, in DataFrame functions only.

A turn holds parts: text, image, audio or document. A visitor flattens a turn's
parts into one string in order: neighbouring texts are joined and then escaped,
so that no control string can be spread over parts; any other part becomes a
placeholder ``<|kind:n|>`` (n counts the turn's parts from 0), an attachment
reference and a count of the tokens it expands to. A part of an unknown kind is
shown as ``<|attachment:n|>`` and keeps its kind in the reference.

Each turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Inside texts and
roles a backslash becomes ``\\`` and ``<|`` becomes ``<\|``, so no text can look
like a control string; a line feed in a role becomes ``\n``. The loss mask lists
the ranges of assistant text, by turn.

Defined cases: null text or role counts as empty; equal turn numbers are ordered
by role, then text; a null conv_id is a conversation of its own; other columns are
ignored; an empty table gives no rows. A conversation is one row of output, so it has to fit a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
KINDS = ("image", "audio", "document")
#: Tokens of an attachment: image patches of this many pixels a side, tokens a second of audio, tokens a page.
PATCH, PER_SECOND, PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are taken from the left, then the marks between them are undone."""
    plain = F.transform(F.split(text, r"\\\\"), lambda x: F.replace(F.replace(x, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def visit(parts: Column) -> Column:
    """struct(body, attachments) of a turn's parts."""

    def tokens(p: Column) -> Column:
        side = lambda x: F.ceil(F.coalesce(x, F.lit(0)) / PATCH)
        return (
            F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
            .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * PER_SECOND))
            .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)).cast("long") * PER_PAGE)
            .otherwise(F.lit(0))
            .cast("long")
        )

    def add(seen: Column, p: Column) -> Column:
        """seen: what is written, the text that is still open, and the number of parts."""
        kind = F.when(p["kind"].isin(*KINDS), p["kind"]).otherwise(F.lit("attachment"))
        mark = F.concat(F.lit("<|"), kind, F.lit(":"), seen["n"].cast("string"), F.lit("|>"))
        is_text = F.coalesce(p["kind"], F.lit("text")) == "text"
        body = F.when(is_text, seen["body"]).otherwise(F.concat(seen["body"], escape(seen["open"]), mark))
        text = F.when(is_text, F.concat(seen["open"], F.coalesce(p["text"], F.lit("")))).otherwise(F.lit(""))
        return F.struct(body.alias("body"), text.alias("open"), (seen["n"] + 1).alias("n"))

    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["kind"].alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens")))
    start = F.struct(F.lit("").alias("body"), F.lit("").alias("open"), F.lit(0).alias("n"))
    body = F.aggregate(parts, start, add, lambda seen: F.concat(seen["body"], escape(seen["open"])))
    return F.struct(body.alias("body"), F.filter(numbered, lambda a: F.coalesce(a["kind"], F.lit("text")) != "text").alias("attachments"))


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, n_turns, loss, attachments, attachment_tokens) from turns (conv_id, turn, role, parts).

    loss: array of (turn, begin, chars, at): the assistant text of that turn, from which character of the turn's
    piece and of the whole; attachments: array of (turn, part, kind, uri, tokens).
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    seen = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), role.alias("shown"), visit(F.coalesce("parts", F.lit(None).cast(PARTS), F.array().cast(PARTS))).alias("v"))
    piece = seen.select("conv_id", "turn", "role", F.concat(F.lit(START), "shown", F.lit("\n")).alias("head"), F.col("v.body").alias("body"), F.col("v.attachments").alias("own"))
    piece = piece.withColumn("chars", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = F.coalesce(F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = piece.withColumn("n", F.row_number().over(order) - 1).withColumn("before", before)
    loss = F.when(F.col("role") == "assistant", F.struct(F.col("n").alias("turn"), F.length("head").alias("begin"), F.length("body").alias("chars"), (F.col("before") + F.length("head")).alias("at")))
    attached = F.transform("own", lambda a: F.struct(F.col("n").alias("turn"), a["part"].alias("part"), a["kind"].alias("kind"), a["uri"].alias("uri"), a["tokens"].alias("tokens")))
    rows = F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"), attached.alias("attached"))))
    out = placed.groupBy("conv_id").agg(rows.alias("rows"), F.count("*").alias("n_turns"))
    return out.select(
        "conv_id",
        F.array_join(F.col("rows.piece"), "").alias("formatted"),
        "n_turns",
        F.filter(F.col("rows.loss"), lambda x: x.isNotNull()).alias("loss"),
        F.flatten(F.col("rows.attached")).alias("attachments"),
        F.aggregate(F.flatten(F.col("rows.attached")), F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text) and loss_text, both taken from ``formatted`` and its mask and unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    cut = formatted.withColumn("_pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
    head = lambda p: F.substring_index(F.substring(p, len(START) + 1, 2147483647), "\n", 1)
    turn = lambda p: F.struct(unescape(head(p)).alias("role"), unescape(p.substr(F.length(head(p)) + len(START) + 2, F.length(p))).alias("text"))
    under = F.transform("loss", lambda s: unescape(F.get("_pieces", s["turn"]).substr(s["begin"] + 1, s["chars"])))
    return cut.withColumn("turns", F.transform("_pieces", turn)).withColumn("loss_text", F.array_join(under, "")).drop("_pieces")


_PROBE = "<|im_end|><|im_start|>assistant ok"


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"))
    out = read_back(chat_format(given.unionByName(probe).select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(told).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'),
e AS (SELECT *, length('<|im_start|><|im_end|>') + 2 + length(role) + length(replace(replace(t, '\', '\\'), '<|', '<\|')) AS n FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS told,
             coalesce(string_agg(t, '' ORDER BY turn, t) FILTER (role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
