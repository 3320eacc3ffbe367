"""Requests of a run: voices, slots, prompts, and what became of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.text import js_trim

FIELDS = ("name", "summary", "role", "goal", "context", "expertise", "asks")
#: Fixed values.
TEMPERATURES = {"low": 0.3, "balanced": 0.7, "creative": 1.0}
MAX_TEXT = 6000


def resolve_personas(library: DataFrame, ids: list[str], overrides: DataFrame | None = None, free_text: str = "") -> DataFrame:
    """(voice_index, id, fields, free_text): known ids in the order asked for, then the free-text voice if it is not blank."""
    spark = library.sparkSession
    own = library.select("id", *FIELDS)
    if overrides is not None:
        new = overrides.select("id", *(F.col(c).alias(f"_{c}") for c in FIELDS))
        extra = overrides.join(library.select("id"), "id", "left_anti").select("id", *FIELDS)
        own = own.join(new, "id", "left").select("id", *(F.coalesce(f"_{c}", c).alias(c) for c in FIELDS)).unionByName(extra)
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(ids) if x != "custom"], "voice_index int, id string")
    out = asked.join(F.broadcast(own), "id").select("voice_index", "id", *FIELDS, F.lit(None).cast("string").alias("free_text"))
    if "custom" in ids and free_text.strip():
        custom = spark.range(1).select(F.lit(len(ids)).alias("voice_index"), F.lit("custom").alias("id"), F.lit("Custom").alias("name"), F.lit(free_text.strip()[:60]).alias("summary"), *(F.lit(None).cast("string").alias(c) for c in FIELDS[2:]), F.lit(free_text.strip()).alias("free_text"))
        out = out.unionByName(custom)
    return out


#: How a persona is described.
PERSONA_HEAD = "PERSONA — the person asking and being answered:"
PERSONA_LINES = (("role", "Who they are"), ("goal", "What they want"), ("context", "Their situation"), ("expertise", "What they already know"), ("asks", "The kind of thing they ask about"))


def describe_persona() -> Column:
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit("")), F.lit(".")) for c, label in PERSONA_LINES]
    labelled = F.concat_ws("\n", F.concat(F.lit(PERSONA_HEAD + " "), "name"), *lines)
    return F.when(F.length("free_text") > 0, F.concat(F.lit(PERSONA_HEAD + "\n"), "free_text")).otherwise(labelled)


def build_specs(chunks: DataFrame, pair_count: int, voices: DataFrame | None = None) -> DataFrame:
    """A row for each request: chunks (doc_id, index, total, …) times voices (voice_index, id, and persona and persona_name where prompts shall show them), with the pairs it has to give.

    Chunks beyond the pairs a voice can give are cut off; the raw number stays as n_chunks_raw.
    """
    given = 0 if voices is None else voices.count()
    n_voices = max(1, given)
    most = max(1, pair_count // n_voices)
    cut = chunks.withColumn("n_chunks_raw", F.col("total")).where(F.col("index") < most).withColumn("total", F.least("total", F.lit(most)))
    if not given:
        crossed = cut.withColumn("voice_index", F.lit(0)).withColumn("persona_id", F.lit(None).cast("string"))
    else:  # one row a persona of the run; their places are counted anew, since unknown ones leave gaps
        place = (F.row_number().over(Window.orderBy("voice_index")) - 1).alias("voice_index")
        crossed = cut.crossJoin(F.broadcast(voices.select(place, F.col("id").alias("persona_id"), *(c for c in ("persona", "persona_name") if c in voices.columns))))
    slots, slot = F.col("total") * n_voices, F.col("index") * n_voices + F.col("voice_index")
    n = F.floor(F.lit(pair_count) / slots) + F.when(slot < F.lit(pair_count) % slots, 1).otherwise(0)
    return crossed.withColumn("pairs", n.cast("int")).where("pairs > 0")


#: What styles and difficulties ask for, and the note behind a text that was cut.
STYLES = {"factual": "Factual Q&A: questions about specific facts", "instruction": "Instruction-following: tasks that the excerpt helps to solve"}
DEPTH = {"basic": "Short, direct questions; answers of 1-3 sentences.", "advanced": "Layered questions that draw on several parts; thorough answers.", "intermediate": "Questions about how things relate; answers of 2-5 sentences."}
CUT_NOTE = "\n\n[... document truncated for length ...]"


def _messages(rows: DataFrame, head: Column, what: str, body: Column, styles: list[str], difficulty: str, domain: str, hint: str) -> DataFrame:
    """Adds messages (system, user), temperature and max_tokens; the voice is taken from the columns persona and persona_name where there are any."""
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    rule = f"You write training pairs for language models from a {what}.\nReturn only a JSON array of objects with instruction, output and type (factual or instruction).\nUse nothing but the {what}, never mention it, and vary the wording."
    voice = F.concat(F.lit("\n\n"), column("persona"), F.lit("\n\nAsk and answer for this person without naming or addressing them; the facts stay those of the text."))
    system = F.concat(F.lit(rule), F.coalesce(voice, F.lit("")))
    asker = F.coalesce(F.concat(F.lit("\n\nEvery pair must be written from the point of view of: "), column("persona_name"), F.lit(".")), F.lit(""))
    lines = [F.lit("\nStyle(s) to use:\n  - " + "\n  - ".join(STYLES[s] for s in styles) + ("\nMix both styles across the pairs." if len(styles) > 1 else "")), F.lit(f"\nDifficulty level: {difficulty}\n{DEPTH.get(difficulty, DEPTH['intermediate'])}")]
    if domain:
        lines.append(F.lit(f'Domain/context tag: "{domain}".'))
    user = F.concat_ws("\n", F.concat(head, asker), *lines, F.concat(F.lit(f"\n---\n{what.upper()}:\n"), body, F.lit("\n---\n\nReturn only the raw JSON array.")))
    both = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    most = F.least(F.lit(16384), F.greatest(F.lit(1024), F.col("pairs") * 300))
    return rows.withColumn("messages", both).withColumn("temperature", F.lit(TEMPERATURES.get(hint, 0.7))).withColumn("max_tokens", most)


def build_prompts(specs: DataFrame, styles: list[str], difficulty: str = "intermediate", domain: str = "", hint: str = "balanced") -> DataFrame:
    """Adds messages, temperature and max_tokens to requests (text, pairs, index, total) for an excerpt each."""
    head = F.format_string("Generate exactly %d question-answer pairs from this document excerpt (part %d of %d).", F.col("pairs"), F.col("index") + 1, F.col("total"))
    return _messages(specs, head, "document excerpt", F.coalesce("text", F.lit("")), styles, difficulty, domain, hint)


def build_document_prompts(docs: DataFrame, pair_count: int, styles: list[str], difficulty: str = "intermediate", domain: str = "", hint: str = "balanced") -> DataFrame:
    """The same in one request for each document (text): the first 6,000 characters, as this form of prompt has it, and a note where there are more."""
    text = F.coalesce("text", F.lit(""))
    body = F.concat(F.substring(text, 1, MAX_TEXT), F.when(F.length(text) > MAX_TEXT, CUT_NOTE).otherwise(""))
    head = F.format_string("Generate exactly %d question-answer pairs from the document below.", F.col("pairs"))
    return _messages(docs.withColumn("pairs", F.lit(pair_count)), head, "document", body, styles, difficulty, domain, hint)


def document_status(results: DataFrame) -> DataFrame:
    """From results (doc_id, chunk_index, voice_index, n_pairs, error): status, pairs, failures and the last error of each document."""
    failed = F.col("error").isNotNull()
    place = F.struct("chunk_index", "voice_index")
    return results.groupBy("doc_id").agg(
        F.when(F.count_if(failed) == F.count("*"), "error").otherwise("done").alias("status"), F.sum(F.coalesce("n_pairs", F.lit(0))).alias("n_pairs"),
        F.count_if(failed).alias("n_failed"), F.max_by("error", F.when(failed, place)).alias("last_error"),
    )
