"""Registered queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.indexing import durable, shared_dir
from pairforge.functions.text import normalise
from pairforge.operators import chunking, curate, dedup, generate, planning, pricing, quality, web
from pairforge.plans.inputs import ALL_SQL, CHUNKS_SQL, PAIRS_SQL, SPECS_SQL, conversation_pairs, document_pairs, specs, table
from pairforge.operators import ledger as ledgers
from pairforge.sources import export, files, listing
from pairforge.streaming import generate as stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_NORM = "trim(regexp_replace(lower(coalesce(instruction, '')), '[^a-z0-9_]+', ' ', 'g'))"
_ISSUES = r"""list_filter([
  CASE WHEN i = '' THEN 'empty_instruction' END, CASE WHEN i <> '' AND length(i) < 10 THEN 'short_instruction' END,
  CASE WHEN o = '' THEN 'empty_output' END, CASE WHEN o <> '' AND length(o) < 20 THEN 'short_output' END,
  CASE WHEN length(o) >= 40 AND NOT regexp_matches(o, '[.!?"'')\]}…]$') THEN 'truncated_output' END,
  CASE WHEN regexp_matches(lower(o), 'according to the (document|text|excerpt|passage|article)|as (stated|mentioned|described|noted) in the (document|text|excerpt|passage)|the (document|text|excerpt|passage) (states|says|mentions|describes|notes)|based on the (provided )?(document|text|excerpt|passage)|in this (document|excerpt|passage)') THEN 'source_leak' END,
  CASE WHEN length(o) > 6000 THEN 'long_output' END, CASE WHEN type = 'factual' AND i <> '' AND NOT contains(i, '?') THEN 'factual_no_question' END,
  CASE WHEN i <> '' AND o <> '' AND lower(i) = lower(o) THEN 'echo' END, CASE WHEN type NOT IN ('factual', 'instruction', '') THEN 'bad_type' END], lambda x: x IS NOT NULL)"""
_T = r"regexp_replace(coalesce({}, ''), '^[\s\x{{00a0}}\x{{feff}}]+|[\s\x{{00a0}}\x{{feff}}]+$', '', 'g')"
_VALID = f"WITH {PAIRS_SQL}, t AS (SELECT id, type, {_T.format('instruction')} AS i, {_T.format('output')} AS o FROM p), v AS (SELECT id, {_ISSUES} AS issues FROM t)"


@query(f"""{ALL_SQL}, n AS (SELECT lang, {_NORM} AS key, row_number() OVER (PARTITION BY {_NORM} ORDER BY doc_id, chunk_index, item_index) AS nth FROM dp)
SELECT lang, count(*) AS n_pairs, count(DISTINCT key) AS n_distinct, count(*) FILTER (key = '' OR nth = 1) AS n_kept FROM n GROUP BY lang""")
def flagship_pairs_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of each language, their distinct instructions, and what is left of them without duplicates."""
    pairs = durable(document_pairs(spark, d).select("id", F.col("id").alias("ord"), "lang", "instruction"))  # made once, read three times
    kept = dedup.remove_duplicates(pairs, dedup.exact_duplicates(pairs)).groupBy("lang").agg(F.count("*").alias("n_kept"))
    own = pairs.groupBy("lang").agg(F.count("*").alias("n_pairs"), F.countDistinct(normalise(F.col("instruction"))).alias("n_distinct"))
    return own.join(kept.withColumnRenamed("lang", "own"), F.col("lang").eqNullSafe(F.col("own")), "left").select("lang", "n_pairs", "n_distinct", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"))


@query(f'WITH RECURSIVE {CHUNKS_SQL} SELECT doc_id, index::INT AS index, total::INT AS total, start::INT AS start, "end"::INT AS "end", md5(text) AS digest FROM k')
def chunk_documents(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "index", "total", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, CASE WHEN n_chars <= 4000 THEN 1 ELSE ceil((n_chars - 300) / 3700.0) END::BIGINT AS n FROM documents")
def estimate_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.estimate_chunks(F.col("n_chars")).alias("n"))


@query(f"WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL} SELECT doc_id, index::INT AS chunk_index, n_chunks_raw::INT AS n_chunks_raw, total::INT AS total, pairs::INT AS pairs FROM s")
def build_specs(spark, d):
    return specs(spark, d).select("doc_id", "chunk_index", "n_chunks_raw", "total", "pairs")


@query(f"{ALL_SQL} SELECT doc_id, chunk_index::INT AS chunk_index, item_index::INT AS item_index, md5(instruction) AS instruction, md5(output) AS output, type FROM dp")
def template_pairs(spark, d):
    return document_pairs(spark, d).select("doc_id", "chunk_index", "item_index", F.md5(F.col("instruction").cast("binary")).alias("instruction"), F.md5(F.col("output").cast("binary")).alias("output"), "type")


@query(ORACLES["template_pairs"])
def parse_responses(spark, d):
    """The generator's pairs written as replies, one in three wrapped in a fence, and read back."""
    pairs = document_pairs(spark, d)
    item = F.struct("item_index", "instruction", "output", "type")
    replies = pairs.groupBy("doc_id", "chunk_index").agg(F.array_sort(F.collect_list(item)).alias("items"))
    raw = F.to_json(F.transform("items", lambda x: F.struct(x["instruction"].alias("instruction"), x["output"].alias("output"), x["type"].alias("type"))))
    fenced = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).otherwise(raw)
    got, _ = generate.parse_responses(replies.select("doc_id", "chunk_index", fenced.alias("response"), F.lit(None).cast("string").alias("error")))
    return got.select("doc_id", "chunk_index", "item_index", F.md5(F.col("instruction").cast("binary")).alias("instruction"), F.md5(F.col("output").cast("binary")).alias("output"), "type")


@query(f"""{ALL_SQL}, n AS (SELECT printf('%012d/%012d/%012d', doc_id, chunk_index, item_index) AS id, {_NORM} AS key FROM dp),
f AS (SELECT id, first_value(id) OVER (PARTITION BY key ORDER BY id) AS keep_id FROM n WHERE key <> '') SELECT id AS dup_id, keep_id FROM f WHERE id <> keep_id""")
def exact_duplicates(spark, d):
    return dedup.exact_duplicates(document_pairs(spark, d).withColumn("ord", F.col("id")))


def _sentence_pairs(spark, d):
    """A pair of each document: its whole first sentence, and the rest. Real exact and near duplicates."""
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, ". ", 1)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), first.alias("instruction"), text.substr(F.length(first) + 3, F.length(text)).alias("output"))


_GRAMS = "CASE WHEN key = '' THEN [] WHEN length(key) < 3 THEN [key] ELSE list_distinct(list_transform(range(1, length(key) - 1), lambda x: substr(key, x, 3))) END"
_EDGES = f"""p AS (SELECT doc_id AS id, split_part(coalesce(text, ''), '. ', 1) AS instruction FROM documents), n AS (SELECT id, {_NORM} AS key FROM p),
x AS (SELECT id, key, min(id) OVER (PARTITION BY key) AS first FROM n), gr AS (SELECT id, {_GRAMS} AS g FROM x WHERE key = '' OR id = first),
e AS (SELECT a.id AS i, b.id AS j FROM gr a JOIN gr b ON a.id < b.id AND least(len(a.g), len(b.g)) >= greatest(len(a.g), len(b.g)) * {{0}} - 1e-9
  WHERE (len(a.g) = 0 AND len(b.g) = 0 AND a.id = (SELECT min(id) FROM gr WHERE len(g) = 0))
     OR len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= {{0}})"""


@query(f"WITH {_EDGES.format(0.7)} SELECT i, j FROM e")
def near_duplicate_edges(spark, d):
    return dedup.near_duplicate_edges(_sentence_pairs(spark, d), 0.7).select("i", "j")


_FOUND = f"""WITH RECURSIVE {_EDGES.format(0.7)}, v AS (SELECT j AS id, list(i ORDER BY i) AS before FROM e GROUP BY j), m AS (SELECT id, before, row_number() OVER (ORDER BY id) AS k FROM v),
r(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT m.k, CASE
  WHEN len(list_filter(before, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, id) ELSE gone END FROM r JOIN m ON m.k = r.k + 1),
last AS (SELECT gone FROM r ORDER BY k DESC LIMIT 1), near AS (SELECT id AS dup_id, list_filter(before, lambda y: NOT list_contains(gone, y))[1] AS keep_id FROM m, last WHERE list_contains(gone, id)),
f AS (SELECT id AS dup_id, first AS keep_id, 'exact' AS match_kind FROM x WHERE key <> '' AND id <> first UNION ALL SELECT dup_id, keep_id, 'fuzzy' FROM near),
found AS (SELECT dup_id, keep_id, match_kind, CASE WHEN bool_or(match_kind = 'exact') OVER (PARTITION BY keep_id) THEN 'exact' ELSE 'fuzzy' END AS group_kind FROM f)"""


@query(f"{_FOUND} SELECT dup_id, keep_id, match_kind, group_kind FROM found")
def find_duplicates(spark, d):
    return dedup.find_duplicates(_sentence_pairs(spark, d), 0.7)


@query(f"{_FOUND} SELECT count(*) FILTER (match_kind = 'exact') AS exact_count, count(*) FILTER (match_kind = 'fuzzy') AS fuzzy_count, count(DISTINCT keep_id) AS n_groups FROM found")
def duplicate_counts(spark, d):
    return dedup.duplicate_counts(dedup.find_duplicates(_sentence_pairs(spark, d), 0.7))


@query(f"{_FOUND} SELECT id FROM p WHERE id NOT IN (SELECT dup_id FROM found)")
def remove_duplicates(spark, d):
    pairs = _sentence_pairs(spark, d)
    return dedup.remove_duplicates(pairs, dedup.find_duplicates(pairs, 0.7)).select("id")


@query(f"WITH {PAIRS_SQL} SELECT id, type FROM p WHERE id % 4 <> 0")
def delete_pairs(spark, d):
    pairs = conversation_pairs(spark, d)
    return curate.delete_pairs(pairs, pairs.where("id % 4 = 0")).select("id", "type")


@query(f"{_VALID} SELECT id, array_to_string(issues, ',') AS codes FROM v")
def validate_pairs(spark, d):
    return quality.validate_pairs(conversation_pairs(spark, d)).select("id", F.array_join(F.col("issues.code"), ",").alias("codes"))


_SAID = """{'empty_instruction': 'no instruction', 'short_instruction': 'the instruction has just ' || length(i) || ' characters', 'empty_output': 'no output',
'short_output': 'the output has just ' || length(o) || ' characters', 'truncated_output': 'the output ends without closing punctuation', 'source_leak': 'the output speaks of its source',
'long_output': 'the output has ' || format('{:,}', length(o)) || ' characters', 'factual_no_question': 'a factual instruction that asks no question', 'echo': 'the output repeats the instruction',
'bad_type': 'unknown type "' || type || '"'}"""


@query(f"""{_VALID}, told AS (SELECT v.id, unnest(v.issues) AS code, generate_subscripts(v.issues, 1) AS n, {_SAID} AS w FROM v JOIN t ON t.id = v.id)
SELECT id, n::INT AS n, code, CASE WHEN code IN ('empty_instruction', 'short_instruction', 'empty_output', 'short_output', 'truncated_output') THEN 'error' ELSE 'warn' END AS severity,
CASE code {" ".join(f"WHEN '{c}' THEN w.{c}" for c in ("empty_instruction", "short_instruction", "empty_output", "short_output", "truncated_output", "source_leak", "long_output", "factual_no_question", "echo", "bad_type"))} END AS message FROM told""")
def pair_issues(spark, d):
    """Every issue of every pair with its place, severity and message."""
    found = quality.validate_pairs(conversation_pairs(spark, d)).select("id", F.posexplode("issues").alias("n", "x"))
    return found.select("id", (F.col("n") + 1).alias("n"), "x.code", "x.severity", "x.message")


_ERR = "len(list_filter(issues, lambda x: x IN ('empty_instruction', 'short_instruction', 'empty_output', 'short_output', 'truncated_output')))"


@query(f"{_VALID} SELECT count(*) FILTER ({_ERR} > 0) AS error_count, count(*) FILTER ({_ERR} = 0 AND len(issues) > 0) AS warn_count, count(*) FILTER (len(issues) > 0) AS flagged_count FROM v")
def quality_summary(spark, d):
    return quality.quality_summary(quality.validate_pairs(conversation_pairs(spark, d)))


def _shaped(schema: str, sql: str):
    def f(spark, d):
        return export.serialize(conversation_pairs(spark, d), "jsonl", schema, ("id",))

    f.__name__ = f"serialize_{schema}"
    query(f"WITH {PAIRS_SQL} SELECT id, to_json({sql})::VARCHAR AS line FROM p")(f)


_shaped("instruction", "{'instruction': instruction, 'output': output, 'type': type}")
_shaped("chatml", "{'messages': [{'role': 'user', 'content': instruction}, {'role': 'assistant', 'content': output}]}")
_shaped("alpaca", "{'instruction': instruction, 'input': '', 'output': output}")
_shaped("sharegpt", "{'conversations': [{'from': 'human', 'value': instruction}, {'from': 'gpt', 'value': output}]}")


def _csv(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[,\"\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query(f"WITH {PAIRS_SQL} SELECT id, {_csv('instruction')} || ',' || {_csv('output')} || ',' || {_csv('type')} AS line FROM p")
def serialize_csv(spark, d):
    return export.serialize(conversation_pairs(spark, d), "csv", keys=("id",))


@query(f"WITH {PAIRS_SQL} SELECT id, rating, persona_id FROM p WHERE type = 'factual' AND persona_id IS NULL AND rating IS NULL AND contains(lower(instruction || ' ' || output), 'the')")
def filter_pairs(spark, d):
    return curate.filter_pairs(conversation_pairs(spark, d), "factual", "none", "unrated", "The").select("id", "rating", "persona_id")


@query(f"{_VALID} SELECT id, 'flagged' AS status FROM v WHERE len(issues) > 0 UNION ALL SELECT id, rating FROM p WHERE rating IN ('up', 'down') UNION ALL SELECT id, 'edited' FROM p WHERE id % 5 = 0")
def filter_pairs_by_status(spark, d):
    pairs = conversation_pairs(spark, d).withColumn("edited", F.col("id") % 5 == 0)
    flagged = quality.validate_pairs(pairs).where(F.size("issues") > 0)
    parts = [curate.filter_pairs(pairs, status=x, flagged=flagged).select("id", F.lit(x).alias("status")) for x in ("flagged", "up", "down", "edited")]
    return curate.append_batches(*parts)


@query(f"{_FOUND} SELECT dup_id AS id FROM found")
def filter_pairs_duplicate(spark, d):
    pairs = _sentence_pairs(spark, d)
    return curate.filter_pairs(pairs, status="duplicate", duplicates=dedup.find_duplicates(pairs, 0.7)).select("id")


@query(f"""WITH {PAIRS_SQL} SELECT id, CASE WHEN id % 15 = 0 THEN output || '?' WHEN id % 5 = 0 THEN output || '!' ELSE output END AS output,
CASE WHEN id % 7 = 0 THEN NULL WHEN id % 15 = 0 THEN 'down' ELSE rating END AS rating, id % 5 = 0 OR id % 7 = 0 AS edited FROM p""")
def upsert_pairs(spark, d):
    """Outputs that change, some twice with the later change first, and ratings that are cleared."""
    pairs = conversation_pairs(spark, d)
    null = F.lit(None).cast("string")
    change = lambda cond, seq, fields, output, rating: pairs.where(cond).select("id", F.lit(seq).alias("seq"), F.array(*map(F.lit, fields)).alias("fields"), output.alias("output"), rating.alias("rating"))
    twice = change("id % 15 = 0", 2, ["output", "rating"], F.concat("output", F.lit("?")), F.lit("down"))
    once = change("id % 5 = 0", 1, ["output"], F.concat("output", F.lit("!")), null)
    cleared = change("id % 7 = 0", 3, ["rating"], null, null)
    return curate.upsert_pairs(pairs, twice.union(once).union(cleared)).select("id", "output", "rating", "edited")


@query(f"WITH {PAIRS_SQL} SELECT id, CASE WHEN n > 0 THEN 'new' ELSE 'old' END AS version FROM (SELECT id, type, count(*) FILTER (id // 1000 % 3 = 0 AND type = 'factual') OVER (PARTITION BY id // 1000) AS n FROM p) WHERE n = 0 OR type = 'factual'")
def replace_documents(spark, d):
    """Conversations as documents: one in three comes again, with its factual pairs only."""
    pairs = conversation_pairs(spark, d).select("id", F.floor(F.col("id") / 1000).alias("doc_id"), "type")
    final = pairs.where("doc_id % 3 = 0 and type = 'factual'")
    return curate.replace_documents(pairs.withColumn("version", F.lit("old")), final.withColumn("version", F.lit("new"))).select("id", "version")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (type = 'factual') AS factual, count(*) FILTER (type = 'instruction') AS instruction, sum(length(instruction) + length(output)) AS chars FROM p)
SELECT factual, instruction, floor(chars / 4 + 0.5)::BIGINT AS tokens, (n - greatest(1, floor(n * 0.1 + 0.5)))::BIGINT AS train, greatest(1, floor(n * 0.1 + 0.5))::BIGINT AS val FROM c""")
def dataset_stats(spark, d):
    return curate.dataset_stats(conversation_pairs(spark, d), 0.1)


@query(f"WITH {PAIRS_SQL} SELECT DISTINCT persona_id, upper(persona_id[1]) || persona_id[2:] AS persona_name FROM p WHERE persona_id IS NOT NULL")
def personas_present(spark, d):
    return curate.personas_present(conversation_pairs(spark, d))


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n
  FROM p), c AS (SELECT max(n) AS n, greatest(1, floor(max(n) * 0.1 + 0.5))::BIGINT AS m FROM r),
v AS (SELECT least(n - 1, floor(k * (n / m) + (n / m) / 2))::BIGINT AS i FROM c, unnest(range(0, m)) AS u(k)) SELECT id, CASE WHEN i IN (SELECT i
  FROM v) THEN 'val' ELSE 'train' END AS split FROM r""")
def split_train_val(spark, d):
    return export.split_train_val(conversation_pairs(spark, d), 0.1, ["id"]).select("id", "split")


@query(f"{ALL_SQL} SELECT doc_id, chunk_index::INT AS chunk_index, item_index::INT AS item_index FROM dp")
def order_pairs(spark, d):
    return curate.order_pairs(document_pairs(spark, d)).select("doc_id", "chunk_index", "item_index")


@query(f"WITH {PAIRS_SQL} SELECT id, 'a' AS batch FROM p UNION ALL SELECT id, 'b' FROM p WHERE type = 'factual'")
def append_batches(spark, d):
    pairs = conversation_pairs(spark, d).select("id", "type")
    return curate.append_batches(pairs.withColumn("batch", F.lit("a")), pairs.where("type = 'factual'").withColumn("batch", F.lit("b"))).select("id", "batch")


def _results(spark, d):
    fail = (F.col("doc_id") % 7 == 0) | ((F.col("doc_id") + F.col("chunk_index")) % 5 == 0)
    e = F.when(fail, F.when(F.col("chunk_index") % 2 == 0, "maximum context length exceeded").otherwise("HTTP 502"))
    return specs(spark, d).select("doc_id", "chunk_index", "voice_index", F.when(~fail, F.col("pairs")).alias("n_pairs"), e.alias("error"))


_RES = f"WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL}, r AS (SELECT doc_id, index, pairs, CASE WHEN doc_id % 7 = 0 OR (doc_id + index) % 5 = 0 THEN CASE WHEN index % 2 = 0 THEN 'maximum context length exceeded' ELSE 'HTTP 502' END END AS error FROM s)"


@query(f"""{_RES} SELECT doc_id, CASE WHEN count(error) = count(*) THEN 'error' ELSE 'done' END AS status, coalesce(sum(pairs) FILTER (error IS NULL), 0)::BIGINT AS n_pairs,
count(error) AS n_failed, arg_max(error, index) FILTER (error IS NOT NULL) AS last_error FROM r GROUP BY doc_id""")
def document_status(spark, d):
    return planning.document_status(_results(spark, d))


@query(f"{_RES} SELECT doc_id, index::INT AS chunk_index, contains(error, 'context') AS overflow, CASE WHEN error = 'HTTP 502' THEN 'network' ELSE 'api' END AS kind FROM r WHERE error IS NOT NULL")
def classify_errors(spark, d):
    return _results(spark, d).where("error is not null").select("doc_id", "chunk_index", generate.is_overflow(F.col("error")).alias("overflow"), generate.classify_errors(F.col("error")).alias("kind"))


@query(f"{_RES} SELECT doc_id, index::INT AS chunk_index FROM r WHERE error IS NOT NULL")
def retry_failed(spark, d):
    return generate.retry_failed(specs(spark, d), _results(spark, d).where("error is not null")).select("doc_id", "chunk_index")


_RAW = """CASE page_id % 8 WHEN 1 THEN concat('  ', url, ' ') WHEN 2 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 3 THEN concat('ftp://', regexp_replace(url, '^[a-z]+://', ''))
  WHEN 4 THEN concat('https://me@', regexp_replace(url, '^[a-z]+://', ''))
WHEN 5 THEN concat(url, ' x') WHEN 6 THEN concat('word', cast(page_id as varchar(20))) WHEN 7 THEN upper(url) ELSE url END"""


@query(rf"""WITH a AS (SELECT page_id, page_id % 8 AS kind, CASE WHEN page_id % 8 = 7 THEN upper(url) ELSE url END AS u FROM pages),
b AS (SELECT page_id, kind, CASE WHEN kind = 2 THEN 'https' ELSE lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) END AS scheme, lower(regexp_extract(u, '^[A-Za-z]+://([^/?#]+)', 1)) AS host, regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(regexp_replace(u, '#.*$', ''), '\?(.*)$', 1) AS q, regexp_extract(u, '(#.+)$', 1) AS f FROM a)
SELECT page_id, CASE WHEN kind IN (0, 1, 2, 7) THEN scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END || f END AS url FROM b""")
def normalize_url(spark, d):
    """Stored addresses, some with blanks around, without a scheme, of another scheme, with credentials, with a blank inside, bare words, in capitals."""
    return table(spark, d, "pages").select("page_id", web.normalize_url(F.expr(_RAW)).alias("url"))


_KEY = r"""kk AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS b FROM pages),
k2 AS (SELECT page_id, url, lower(regexp_extract(b, '^[^:]+://[^/?]*', 0)) AS origin, regexp_extract(b, '^[^:]+://[^/?]*([^?]*)', 1) AS path, regexp_extract(b, '\?(.*)$', 1) AS q FROM kk),
k3 AS (SELECT page_id, url, origin, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') WHEN path = '' THEN '/' ELSE path END AS path,
  array_to_string(list_sort(list_filter(string_split(q, '&'), lambda x: x <> ''
  AND split_part(x, '=', 1) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'utm_id', 'gclid', 'fbclid', 'msclkid', 'igshid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'referrer', '_ga', 'yclid', 'spm'))), '&') AS q FROM k2),
key AS (SELECT page_id, url, origin || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM k3)"""


@query(f"WITH {_KEY} SELECT page_id, key FROM key")
def url_dedupe_key(spark, d):
    return table(spark, d, "pages").select("page_id", web.url_dedupe_key(F.col("url")).alias("key"))


_FORMED = """concat(regexp_extract(url, '^[^:]+://[^/?#]*', 0), CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/x/..'
  WHEN 2 THEN '/./%2E' ELSE '/y/./z/%2e./..' END, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1),
CASE page_id % 3 WHEN 0 THEN "?b=x+y&a=~1&c=(1)%27" WHEN 1 THEN "?c=%281)'&b=x%20y&a=%7e1&utm_source=q" ELSE "?a=%7E1&b=x y&c=%28%31%29%27#frag" END)"""


@query(rf"""WITH {_KEY} SELECT page_id, regexp_replace(key, '\?.*$', '') || '?a=%7E1&b=x+y&c=%281%29%27' AS key FROM key""")
def url_forms(spark, d):
    """The addresses with dot segments put in and one query spelled three ways: a page keeps one key."""
    return table(spark, d, "pages").select("page_id", web.url_dedupe_key(F.expr(_FORMED)).alias("key"))


@query(f"WITH {_KEY} SELECT min(page_id) AS page_id, key FROM key GROUP BY key")
def dedupe_pages(spark, d):
    return web.dedupe_pages(table(spark, d, "pages")).select("page_id", "key")


@query(r"""WITH s AS (SELECT page_id, list_filter(string_split(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[^:]+://[^/]*(.*)$', 1), '/'), lambda x: x <> '') AS seg, lower(regexp_extract(url, '^[^:]+://([^/?#:]+)', 1)) AS host FROM pages)
SELECT page_id, lpad(page_id::VARCHAR, greatest(2, length(page_id::VARCHAR))::INT, '0') || '-' || CASE
  WHEN len(seg) = 0 THEN regexp_replace(host, '\.[a-z0-9]{1,8}$', '', 'i') ELSE regexp_replace(seg[-1], '\.[a-z0-9]{1,8}$', '', 'i') END || '.html' AS name FROM s""")
def page_name(spark, d):
    return table(spark, d, "pages").select("page_id", web.page_name(F.col("url"), F.lit(".html"), F.col("page_id")).alias("name"))


_CT = "CASE page_id % 5 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' WHEN 3 THEN 'text/csv' ELSE NULL END"


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.pdf' WHEN 3 THEN '.csv' END AS ext FROM pages")
def content_type_ext(spark, d):
    return table(spark, d, "pages").select("page_id", web.content_type_ext(F.expr(_CT)).alias("ext"))


_PATH = "regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1)"
_RULES = f"SELECT DISTINCT regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS site, page_id % 2 = 0 AS allow, substr({_PATH}, 1, (2 + page_id % 9)::INT) AS path FROM pages"


@query(f"""WITH rules AS ({_RULES}), u AS (SELECT page_id, regexp_extract(url, '^[^:]+://([^/?#]+)', 1) AS site, {_PATH} AS path FROM pages)
SELECT page_id, coalesce(arg_max(r.allow, length(r.path) * 2 + r.allow::INT), true) AS allowed FROM u LEFT JOIN rules r ON r.site = u.site AND starts_with(u.path, r.path) GROUP BY page_id""")
def robots_allowed(spark, d):
    p = table(spark, d, "pages")
    site, path = F.regexp_extract("url", "^[^:]+://([^/?#]+)", 1), F.regexp_extract("url", "^[^:]+://[^/?#]*([^?#]*)", 1)
    rules = p.select(site.alias("site"), (F.col("page_id") % 2 == 0).alias("allow"), F.expr("substr(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), 1, cast(2 + page_id % 9 as int))").alias("path")).distinct()
    return web.robots_allowed(p.select("page_id", site.alias("site"), path.alias("path")), rules).select("page_id", "allowed")


@query(f"SELECT DISTINCT site, allow, path FROM ({_RULES}) WHERE path <> ''")
def parse_robots(spark, d):
    """The same rules written as one robots file a site, with another agent's group and comments around, and parsed."""
    p = table(spark, d, "pages")
    site = F.regexp_extract("url", "^[^:]+://([^/?#]+)", 1)
    rule = F.concat(F.when(F.col("page_id") % 2 == 0, "Allow: ").otherwise("Disallow: "), F.expr("substr(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), 1, cast(2 + page_id % 9 as int))"), F.lit("  # why"))
    lines = p.groupBy(site.alias("site")).agg(F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-Agent: *\n"), F.array_join(F.collect_set(rule), "\n"), F.lit("\nDisallow:\nUser-agent: last\nAllow: /x")).alias("text"))
    return web.parse_robots(lines).distinct()


@query(r"""WITH tok AS (
  SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS n
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>|[^<]+') AS x FROM pages)),
tag AS (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z0-9]+)', 1)) AS tag, starts_with(t, '</') AS ends FROM tok WHERE t NOT LIKE '<!%' AND t NOT LIKE '<script%' AND t NOT LIKE '<style%'),
ev AS (
  SELECT *, sum(CASE WHEN tag = 'article' AND NOT ends THEN 1 ELSE 0 END) OVER w AS nth,
         sum(CASE WHEN tag <> 'article' THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER w AS inside,
         sum(CASE WHEN tag NOT IN ('nav', 'header', 'footer', 'aside', 'form', 'button', 'noscript', 'iframe', 'svg') THEN 0 WHEN ends THEN -1 ELSE 1 END) OVER w AS noise,
         last_value(CASE WHEN tag = 'p' THEN NOT ends END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p_open
  FROM tag WINDOW w AS (PARTITION BY page_id ORDER BY n)),
piece AS (
  SELECT page_id, n, CASE WHEN tag = '' THEN replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')
         WHEN tag = 'br' OR t = '</h1>' OR (tag = 'p' AND p_open) THEN chr(10) ELSE '' END AS s
  FROM ev WHERE nth = 1 AND inside = 1 AND noise = 0),
whole AS (SELECT page_id, regexp_replace(regexp_replace(string_agg(s, '' ORDER BY n), '[ \t\x{00a0}]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS s FROM piece GROUP BY page_id)
SELECT page_id, regexp_replace(regexp_replace(s, '(?m)^[ \t]+|[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g') AS text FROM whole""")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", web.html_to_text(F.col("html")).alias("text"))


_LINKS = r"""lp AS (SELECT page_id, url, regexp_extract(url, '^[^:]+://[^/?#]+', 0) AS origin, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), 1) - 1 AS pos FROM pages),
lh AS (SELECT url, pos, lower(origin) AS origin, array_to_string(list_transform(string_split(regexp_replace(replace(raw, '&amp;', '&'), '#.*$', ''), ''),
  lambda c: CASE WHEN ord(c) > 126 THEN url_encode(c) ELSE c END), '') AS there FROM lp),
lk AS (SELECT url, pos, origin || there AS href, origin || CASE WHEN length(there) > 1 THEN regexp_replace(there, '/$', '') ELSE there END AS key FROM lh),
lg AS (SELECT url, key, min(pos)::INT AS pos, arg_max(href, pos) AS href FROM lk GROUP BY url, key)"""


@query(f"WITH {_LINKS} SELECT url, false AS noindex, false AS nofollow, pos, key, href FROM lg")
def extract_links(spark, d):
    return web.extract_links(table(spark, d, "pages").select("url", "html"))


def _linked_pages(spark, d):
    """The stored pages as one site, each with links to three others by its number; one in eleven is kept out of the index and one in thirteen is an image."""
    p = table(spark, d, "pages")
    n = p.count()
    at = lambda k: F.concat(F.lit("https://site.example.org/p/"), ((F.col("page_id") * 7 + k * 31) % n).cast("string"), F.when(F.col("page_id") % 2 == 0, "?utm_source=x").otherwise(""))
    body = F.concat(*(F.concat(F.lit('<a href="'), at(k), F.lit('">x</a>')) for k in (1, 2, 3)), F.lit('<a href="/private/x">x</a>'))
    meta = F.when(F.col("page_id") % 11 == 5, '<meta name="robots" content="noindex">').otherwise("")
    kind = F.when(F.col("page_id") % 13 == 6, "image/png").otherwise("text/html; charset=utf-8")
    return p.select(F.concat(F.lit("https://site.example.org/p/"), F.col("page_id").cast("string")).alias("url"), kind.alias("content_type"), F.concat(meta, body).alias("html"))


_WALK = """z AS (SELECT count(*) AS n FROM pages), ln AS (SELECT page_id AS a, k - 1 AS pos, (page_id * 7 + k * 31) % n AS b FROM pages, z, unnest([1, 2, 3]) AS u(k)),
lu AS (SELECT a, b, min(pos) AS pos, arg_max(a % 2 = 0, pos) AS tracked FROM ln GROUP BY a, b),
d0 AS (SELECT 0::BIGINT AS id, '0' AS place, 0 AS depth, false AS tracked),
d1 AS (SELECT b AS id, arg_min(tracked, place) AS tracked, min(place) AS place FROM (SELECT b, d0.place || ',' || lu.pos AS place, lu.tracked FROM d0 JOIN lu ON lu.a = d0.id)
  WHERE b NOT IN (SELECT id FROM d0) GROUP BY b),
d2 AS (SELECT b AS id, arg_min(tracked, place) AS tracked, min(place) AS place FROM (SELECT b, d1.place || ',' || lu.pos AS place, lu.tracked FROM d1 JOIN lu ON lu.a = d1.id
  WHERE d1.id % 13 <> 6) WHERE b NOT IN (SELECT id FROM d0 UNION ALL SELECT id FROM d1) GROUP BY b),
w AS (SELECT id, place, 0 AS depth, tracked FROM d0 UNION ALL SELECT id, place, 1, tracked FROM d1 UNION ALL SELECT id, place, 2, tracked FROM d2),
t AS (SELECT id, depth, place, tracked, id % 13 = 6 AS image, id % 11 = 5 AS hidden FROM w), o AS (SELECT *, NOT image AND NOT hidden AS good, coalesce(sum((NOT image
  AND NOT hidden)::INT) OVER (ORDER BY depth, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM t)"""
_AT = "'https://site.example.org/p/' || id || CASE WHEN tracked THEN '?utm_source=x' ELSE '' END"


def _crawled(spark, d):
    starts = spark.createDataFrame([("site.example.org", "https://site.example.org/p/0")], "site string, url string")
    rules = spark.createDataFrame([("site.example.org", False, "/private")], "site string, allow boolean, path string")
    return web.crawl_pages(_linked_pages(spark, d), rules, starts, 2, 9)


@query(f"WITH {_WALK} SELECT 'site.example.org' AS site, (had + 1)::INT AS n, {_AT} AS url, '.html' AS ext, printf('%02d', (had + 1)::INT) || '-' || id || '.html' AS name FROM o WHERE good AND had < 9")
def crawl_pages(spark, d):
    """Two levels of a walk over the stored pages, nine pages at most: both limits are the feature."""
    return _crawled(spark, d)[0].select("site", F.col("n").cast("int").alias("n"), "url", "ext", "name")


@query(f"""WITH {_WALK} SELECT 'site.example.org' AS site, {_AT} AS url, CASE WHEN image THEN 'unsupported' ELSE 'noindex' END AS reason, CASE WHEN image THEN 'image/png' END AS detail
  FROM o WHERE NOT good AND had < 9
UNION ALL SELECT 'site.example.org', 'https://site.example.org/private/x', 'robots', NULL""")
def crawl_skipped(spark, d):
    return _crawled(spark, d)[1].select("site", "url", "reason", "detail")


_FILE = """concat(CASE c_custkey % 9 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/lib/' WHEN 2 THEN 'home/.ssh/' WHEN 3 THEN 'docs/build/' ELSE 'docs/' END,
CASE c_custkey % 11 WHEN 0 THEN '.env.local' WHEN 1 THEN 'id_rsa' WHEN 2 THEN 'server.PEM' WHEN 3 THEN 'api_tokens.yaml' WHEN 4 THEN 'Makefile' WHEN 5 THEN 'photo.png'
WHEN 6 THEN concat('rows', cast(c_custkey as varchar(20)), '.CSV') WHEN 7 THEN 'README' ELSE concat('note', cast(c_custkey as varchar(20)), '.md') END)"""
_SIZE = "CASE WHEN c_custkey % 13 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN 6291456 ELSE c_custkey * 37 END"
_LIST = f"l0 AS (SELECT c_custkey AS id, {_FILE} AS path, {_SIZE} AS size FROM customer), l AS (SELECT *, split_part(path, '/', -1) AS name FROM l0)"
_VERDICT = f"""WITH {_LIST}, x AS (SELECT *, lower(regexp_extract(name, '\\.[^.]*$', 0)) AS e FROM l),
v AS (SELECT id, path, size, CASE WHEN path LIKE 'home/.ssh/%' THEN 'secret' WHEN path LIKE 'node_modules/%' OR path LIKE 'docs/build/%' THEN 'noise' WHEN e = '.pem' THEN 'secret'
  WHEN name IN ('.env.local', 'id_rsa', 'api_tokens.yaml') THEN 'secret' WHEN size = 0 THEN 'empty' WHEN size > 5242880 THEN 'too-large' WHEN e NOT IN ('.csv', '.md')
  AND name <> 'Makefile' THEN 'unsupported' END AS reason,
  CASE WHEN path LIKE 'home/.ssh/%' THEN 'inside .ssh/' WHEN path LIKE 'node_modules/%' THEN 'inside node_modules/' WHEN path LIKE 'docs/build/%' THEN 'inside build/'
  WHEN e = '.pem' THEN '.pem key or certificate'
  WHEN name IN ('.env.local', 'id_rsa', 'api_tokens.yaml') THEN name WHEN size = 0 THEN NULL WHEN size > 5242880 THEN '6.0 MB' WHEN e NOT IN ('.csv', '.md') AND name <> 'Makefile' THEN
  CASE WHEN e = '' THEN 'no extension' ELSE e END END AS detail FROM x)"""


def _files(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.expr(_FILE).alias("path"), F.expr(_SIZE).cast("long").alias("size")).withColumn("name", F.element_at(F.split("path", "/"), -1))


@query(f"{_VERDICT} SELECT id, reason IS NOT NULL AS excluded, reason, detail FROM v")
def classify_paths(spark, d):
    return listing.classify_paths(_files(spark, d)).select("id", "excluded", "reason", "detail")


@query(f"{_VERDICT} SELECT reason, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY reason")
def partition_listing(spark, d):
    return listing.partition_listing(_files(spark, d))[2]


@query(f"WITH {_LIST} SELECT id, CASE WHEN name LIKE '%.md' THEN 'prose' WHEN name LIKE '%.CSV' THEN 'data' WHEN name IN ('Makefile', 'api_tokens.yaml') THEN 'code' END AS kind FROM l")
def assign_kind(spark, d):
    return listing.assign_kind(_files(spark, d)).select("id", "kind")


@query(f"{_VERDICT} SELECT id, path FROM v WHERE reason IS NULL ORDER BY path, id LIMIT 200")
def select_first(spark, d):
    return listing.select_first(listing.partition_listing(_files(spark, d))[0], 200).select("id", "path")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'unsupported'
  WHEN length(regexp_replace(coalesce(text, ''), '^[\s\x{00a0}\x{feff}]+|[\s\x{00a0}\x{feff}]+$', '', 'g')) < 25 THEN 'too-short' END AS reject_reason,
CASE doc_id % 3 WHEN 0 THEN 'prose' WHEN 1 THEN CASE WHEN doc_id % 9 <> 4 THEN 'code' END ELSE 'data' END AS kind FROM documents""")
def accept_documents(spark, d):
    """Documents under names of three kinds, some of no kind."""
    name = F.expr("concat('d', doc_id, CASE WHEN doc_id % 9 = 4 THEN '.bmp' WHEN doc_id % 3 = 0 THEN '.TXT' WHEN doc_id % 3 = 1 THEN '.py' ELSE '.csv' END)")
    good, bad = listing.accept_documents(table(spark, d, "documents").select("doc_id", "text", name.alias("name")))
    return good.select("doc_id", F.lit(None).cast("string").alias("reject_reason"), "kind").union(bad.select("doc_id", "reject_reason", "kind"))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) AS n, 'Record ' || row_number() OVER (ORDER BY c_custkey) || chr(10) || 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || trim(c_name) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) || 'segment: ' || trim(c_mktsegment) END AS text FROM customer""")
def render_records(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise("  ").alias("segment"))
    return listing.render_records(c, ["c_custkey", "c_name", "segment"], ["c_custkey"])


@query("""SELECT c_custkey AS id, r_name || '/' || n_name || '/' || c_name || CASE WHEN c_custkey % 2 = 0 THEN '.txt' ELSE '' END AS path, (CASE
  WHEN c_custkey % 5 = 0 THEN 4096 ELSE c_custkey END)::BIGINT AS size
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def listing_paths(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("long")
    files = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "application/vnd.google-apps.document").otherwise("text/plain").alias("mime"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(F.col("c_custkey")).cast("long").alias("size"), F.lit(False).alias("is_folder"))
    mid = n.select(F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey")), "n_name", none, zero, F.lit(True))
    top = r.select(F.concat(F.lit("r"), F.col("r_regionkey")), none, "r_name", none, zero, F.lit(True))
    out = listing.listing_paths(files.union(mid).union(top))
    return out.select(F.substring("id", 2, 20).cast(dict(c.dtypes)["c_custkey"]).alias("id"), "path", "size")


_MODEL = "CASE c_custkey % 6 WHEN 0 THEN 'GPT-4o-mini-2024' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'my-llama-3.1-8b' WHEN 3 THEN 'unknown' WHEN 4 THEN 'openai/o1-mini' ELSE NULL END"
_PROVIDER = "CASE WHEN c_custkey % 10 = 0 THEN 'mock' ELSE 'api' END"


@query(f"""WITH r AS (SELECT c_custkey AS id, {_PROVIDER} AS provider, lower({_MODEL}) AS model FROM customer)
SELECT id, CASE WHEN provider = 'mock' THEN 0.0 WHEN contains(model, 'gpt-4o-mini') THEN 0.15 WHEN contains(model, 'gpt-4o') THEN 2.5 WHEN contains(model, 'llama') THEN 0.18
  WHEN contains(model, 'o1-mini') THEN 1.1 END::DOUBLE AS price_in,
CASE WHEN provider = 'mock' THEN 0.0 WHEN contains(model, 'gpt-4o-mini') THEN 0.6 WHEN contains(model, 'gpt-4o') THEN 10.0 WHEN contains(model, 'llama') THEN 0.18
  WHEN contains(model, 'o1-mini') THEN 4.4 END::DOUBLE AS price_out FROM r""")
def price_lookup(spark, d):
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.expr(_PROVIDER).alias("provider"), F.expr(_MODEL).alias("model"))
    return pricing.price_lookup(runs).select("id", "price_in", "price_out")


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, c AS (SELECT count(*) AS n, count(*) FILTER (index = 0) AS docs, sum("end" - start) AS chars FROM k WHERE index < 3),
t AS (SELECT n * 3 AS requests, docs * 10 AS pairs, ceil((chars + n * 1200) * 3 / 4)::BIGINT AS tokens_in, ceil(docs * 5000 / 4)::BIGINT AS tokens_out FROM c)
SELECT requests, pairs, tokens_in, tokens_out, tokens_in / 1e6 * 2.5 + tokens_out / 1e6 * 10.0 AS cost_usd, ceil(requests / 3 * 6)::BIGINT AS seconds FROM t""")
def estimate_run(spark, d):
    return pricing.estimate_run(table(spark, d, "documents"), 10, 3, 3, "api", "gpt-4o-2024")


@query(f"""WITH {_LIST}, c AS (SELECT sum(size)::BIGINT AS bytes, count(*) AS docs FROM l), n AS (SELECT *, docs * least(12, greatest(1, ceil(bytes / docs / 3700)))::BIGINT AS requests FROM c),
t AS (SELECT requests, ceil((bytes + requests * 1200) / 4)::BIGINT AS tokens_in, ceil(docs * 6000 / 4)::BIGINT AS tokens_out FROM n)
SELECT requests, tokens_in, tokens_out, (tokens_in * 2.5 + tokens_out * 10.0) / 1e6 AS cost_usd, (tokens_in * 2.5 + tokens_out * 10.0) / 1e6 >= 5 AS warn, ceil(requests / 3 * 6)::BIGINT AS seconds FROM t""")
def estimate_from_listing(spark, d):
    return pricing.estimate_from_listing(_files(spark, d), 12, 3, "api", "gpt-4o")


@query("""SELECT (CASE n_name WHEN 'NATION_3' THEN 0 ELSE 2 END)::INT AS voice_index, n_name AS id, CASE n_name WHEN 'NATION_3' THEN 'changed' ELSE 'region ' || n_regionkey END AS role
  FROM nation WHERE n_name IN ('NATION_3', 'NATION_9')
UNION ALL SELECT 4, 'custom', NULL""")
def resolve_personas(spark, d):
    n = table(spark, d, "nation")
    text = lambda s: F.lit(s)
    lib = n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), text("").alias("summary"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("role"), *(text("").alias(c) for c in ("goal", "context", "expertise", "asks")))
    over = lib.where("id = 'NATION_3'").select("id", *(F.lit("changed" if c == "role" else None).cast("string").alias(c) for c in planning.FIELDS))
    return planning.resolve_personas(lib, ["NATION_3", "nowhere", "NATION_9", "custom"], over, " a careful reader ").select("voice_index", "id", "role")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _prompt_sql(what: str, head: str, body: str, styles: str, level: str) -> str:
    """(user, system, max_tokens) of a prompt as SQL; what they say is fixed text, put together here once more."""
    system = _quoted(f"You write training pairs for language models from a {what}.\nReturn only a JSON array of objects with instruction, output and type (factual or instruction).\nUse nothing but the {what}, never mention it, and vary the wording.")
    asked = _quoted(f"\n\nStyle(s) to use:\n  - {styles}\n\nDifficulty level: {level}\n\n---\n{what.upper()}:\n")
    return f"{head} || {asked} || {body} || {_quoted(chr(10) + '---' + chr(10) * 2 + 'Return only the raw JSON array.')} AS q, {system} AS system"


_CHUNK_PROMPT = _prompt_sql("document excerpt", "'Generate exactly ' || pairs || ' question-answer pairs from this document excerpt (part ' || (index + 1) || ' of ' || total || ').'", "text", planning.STYLES["factual"], "basic\n" + planning.DEPTH["basic"])
_PROMPTS = f"WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL}, pr AS (SELECT doc_id, index, pairs, text, {_CHUNK_PROMPT} FROM s)"


def _prompts(spark, d):
    return planning.build_prompts(specs(spark, d).withColumn("index", F.col("chunk_index")), ["factual"], "basic")


def _shown(p):
    digest = lambda i: F.md5(F.col("messages")[i]["content"].cast("binary"))
    roles = F.array_join(F.col("messages.role"), ",")
    return p.select(*(c for c in ("doc_id", "chunk_index") if c in p.columns), roles.alias("roles"), digest(0).alias("system"), digest(1).alias("user"), "temperature", "max_tokens")


@query(f"{_PROMPTS} SELECT doc_id, index::INT AS chunk_index, 'system,user' AS roles, md5(system) AS system, md5(q) AS user, 0.7::DOUBLE AS temperature, greatest(1024, 300 * pairs)::INT AS max_tokens FROM pr")
def build_prompts(spark, d):
    return _shown(_prompts(spark, d))


_DOC_PROMPT = _prompt_sql("document", "'Generate exactly 7 question-answer pairs from the document below.'", f"left(coalesce(text, ''), 6000) || CASE WHEN length(text) > 6000 THEN {_quoted(planning.CUT_NOTE)} ELSE '' END", planning.STYLES["factual"] + "\n  - " + planning.STYLES["instruction"] + "\nMix both styles across the pairs.", "advanced\n" + planning.DEPTH["advanced"])


@query(f"WITH pr AS (SELECT doc_id, {_DOC_PROMPT} FROM documents) SELECT doc_id, 'system,user' AS roles, md5(system) AS system, md5(q) AS user, 1.0::DOUBLE AS temperature, 2100 AS max_tokens FROM pr")
def build_document_prompts(spark, d):
    """One request for each document: 6,000 characters of it are what this form of prompt holds."""
    return _shown(planning.build_document_prompts(table(spark, d, "documents").select("doc_id", "text"), 7, ["factual", "instruction"], "advanced", hint="creative"))


@query(f"""{_PROMPTS} SELECT doc_id, index::INT AS chunk_index, CASE WHEN length(q) % 7 > 0 THEN length(q) || '/' || greatest(1024, 300 * pairs) || '/0.7' END AS response, CASE WHEN length(q) % 7 = 0 THEN 'HTTP 502 at ' || length(q) END AS error FROM pr""")
def complete(spark, d):
    """The completion hook with a service that measures its prompt and fails on some."""

    def service(messages, settings):
        n = len(messages[1]["content"])
        if n % 7 == 0:
            raise ValueError(f"HTTP 502 at {n}")
        return f"{n}/{settings['max_tokens']}/{settings['temperature']}"

    return generate.complete(_prompts(spark, d), service).select("doc_id", "chunk_index", "response", "error")


_HALF = "CASE WHEN {0} > 1200 THEN ceil({0} / 2)::INT ELSE {0} END"
_LESS = "CASE WHEN {0} > 1200 THEN greatest(1, ceil({1} / 2))::INT ELSE {1} END"


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL}, h0 AS (SELECT doc_id, index, text, length(text) AS n, pairs FROM s),
h1 AS (SELECT doc_id, index, text, {_HALF.format('n')} AS n, {_LESS.format('n', 'pairs')} AS pairs
  FROM h0), h2 AS (SELECT doc_id, index, text, {_HALF.format('n')} AS n, {_LESS.format('n', 'pairs')} AS pairs FROM h1),
h3 AS (SELECT doc_id, index, text, {_HALF.format('n')} AS n, {_LESS.format('n', 'pairs')} AS pairs FROM h2)
SELECT doc_id, index::INT AS chunk_index, n::INT AS n_chars, pairs::INT AS pairs, md5(left(text, n)) AS response, NULL::VARCHAR AS error FROM h3""")
def shrink_retry(spark, d):
    """Excerpts of more than 1,200 characters overflow; the service answers with a digest of what it was shown."""

    def service(messages, settings):
        import hashlib

        text = messages[1]["content"].split("DOCUMENT EXCERPT:\n", 1)[1].rsplit("\n---\n", 1)[0]
        if len(text) > 1200:
            raise ValueError("maximum context length exceeded")
        return hashlib.md5(text.encode()).hexdigest()

    done = generate.shrink_retry(specs(spark, d).withColumn("index", F.col("chunk_index")), service, styles=["factual"])
    return done.select("doc_id", "chunk_index", F.length("text").alias("n_chars"), "pairs", "response", "error")


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, c0 AS (SELECT doc_id, length(text) AS n, total FROM k WHERE index = 0)
SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'asked of part 1 of ' || total ELSE 'old' END AS instruction, CASE WHEN doc_id % 10 = 0 THEN n || ' characters' ELSE 'old' END AS output,
CASE WHEN doc_id % 2 = 0 THEN 'instruction' ELSE 'factual' END AS type, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 'up' END AS rating, doc_id % 10 <> 0 AS edited FROM c0""")
def regenerate_pairs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    old = lambda c: F.lit("old").alias(c)
    pairs = docs.select(F.col("doc_id").alias("id"), "doc_id", old("instruction"), old("output"), F.when(F.col("doc_id") % 2 == 0, "instruction").otherwise("factual").alias("type"), F.lit("up").alias("rating"), F.lit(True).alias("edited"))

    def service(messages, settings):
        import json

        asked = messages[1]["content"]
        text = asked.split("DOCUMENT EXCERPT:\n", 1)[1].rsplit("\n---\n", 1)[0]
        kind = "instruction" if "Instruction-following" in asked.split("\n---\n", 1)[0] else "factual"
        return json.dumps([{"instruction": "asked of " + asked.split("(", 1)[1].split(")", 1)[0], "output": f"{len(text)} characters", "type": kind}])

    return generate.regenerate_pairs(pairs, pairs.where("id % 10 = 0").select("id"), docs, service).select("id", "instruction", "output", "type", "rating", "edited")


@query(f"""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN {_quoted(planning.PERSONA_HEAD)} || chr(10) || c_name ELSE {_quoted(planning.PERSONA_HEAD)} || ' ' || c_name || chr(10) || {" || chr(10) || ".join(_quoted(label + ': ') + f" || coalesce({column}, '') || '.'" for (_, label), column in zip(planning.PERSONA_LINES, ("c_mktsegment", "c_name", "NULL::VARCHAR", "c_custkey::VARCHAR", "''"), strict=True))} END AS text FROM customer""")
def describe_persona(spark, d):
    """Customers as voices, one in five in free text."""
    c = table(spark, d, "customer")
    known = {"name": F.col("c_name"), "role": F.col("c_mktsegment"), "goal": F.col("c_name"), "context": F.lit(None).cast("string"), "expertise": F.col("c_custkey").cast("string"), "asks": F.lit("")}
    free = F.when(F.col("c_custkey") % 5 == 0, F.col("c_name")).alias("free_text")
    return c.select(F.col("c_custkey").alias("id"), *(v.alias(k) for k, v in known.items()), free).select("id", planning.describe_persona().alias("text"))


_SECTION = "replace(replace(coalesce(text, ''), '. ', concat('.', chr(10))), ', ', concat(',', chr(10), '  '))"


def _code_break(st: str) -> str:
    s = f"substr(text, {st} + 3201, 802)"
    top = f"regexp_extract(reverse({s}), '(?s)^(.*?)[^ \\t]\\n', 1)"
    any_ = f"substr(text, {st} + 3201, 801)"
    return f"""CASE WHEN strpos({s}, chr(10) || chr(10)) > 0 THEN {st} + 3200 + length({s}) - strpos(reverse({s}), chr(10) || chr(10)) + 1
    WHEN regexp_matches({s}, '(?s)\\n[^ \\t]') THEN {st} + 3200 + length({s}) - length({top}) - 1
    WHEN strpos({any_}, chr(10)) > 0 THEN {st} + 3200 + length({any_}) - strpos(reverse({any_}), chr(10)) + 1 ELSE {st} + 4000 END"""


@query(f"""WITH RECURSIVE sec AS (SELECT doc_id, {_SECTION} AS text FROM documents),
w(doc_id, text, index, st, fin) AS (SELECT doc_id, text, 0, 0, CASE WHEN length(text) <= 4000 THEN length(text) ELSE {_code_break('0')} END FROM sec
  UNION ALL SELECT doc_id, text, index + 1, st, CASE WHEN st + 4000 >= length(text) THEN length(text) ELSE {_code_break('st')} END
  FROM (SELECT doc_id, text, index, greatest(st + 1, fin - 300) AS st, fin FROM w WHERE fin < length(text)))
SELECT doc_id, index::INT AS index, count(*) OVER (PARTITION BY doc_id)::INT AS total, st::INT AS start, fin::INT AS "end", md5(substr(text, st + 1, fin - st)) AS digest FROM w""")
def chunk_code(spark, d):
    """All documents as code, with line feeds and indented lines put in."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_SECTION).alias("text"), F.lit("code").alias("kind"))
    return chunking.chunk_documents(docs).select("doc_id", "index", "total", "start", "end", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n, c_nationkey % 2 = 0 AS named FROM customer),
r AS (SELECT c_nationkey, n, 'Record ' || n || chr(10) || CASE WHEN named THEN 'name' ELSE 'Column 1' END || ': ' || trim(c_name) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE chr(10) ||
  CASE WHEN named THEN 'segment' ELSE 'Column 2' END || ': ' || trim(c_mktsegment) END || chr(10) || 'Column 3: ' || c_custkey AS text FROM c)
SELECT 'nation-' || c_nationkey || '.csv' AS path, string_agg(text, chr(10) || chr(10) ORDER BY n) AS text FROM r GROUP BY c_nationkey""")
def delimited_documents(spark, d):
    """Customers as a delimited file a nation: every other one with a header of two names, and a third cell beyond it."""
    c = table(spark, d, "customer")
    cells = F.array("c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(" "), F.col("c_custkey").cast("string"))
    file = F.concat(F.lit("nation-"), F.col("c_nationkey"), F.lit(".csv"))
    first = c.where("c_nationkey % 2 = 0").select(file.alias("path"), F.lit(-1).cast("long").alias("ord"), F.array(F.lit("name"), F.lit(" segment ")).alias("cells")).distinct()
    return files.delimited_documents(c.select(file.alias("path"), F.col("c_custkey").cast("long").alias("ord"), cells.alias("cells")).union(first))


def _output(spark, name: str) -> str:
    """A new folder in the one that the cluster shares."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"""WITH {PAIRS_SQL}, r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n
  FROM p), c AS (SELECT max(n) AS n, greatest(1, floor(max(n) * 0.1 + 0.5))::BIGINT AS m FROM r),
v AS (SELECT least(n - 1, floor(k * (n / m) + (n / m) / 2))::BIGINT AS i FROM c, unnest(range(0, m)) AS u(k))
SELECT CASE WHEN i IN (SELECT i FROM v) THEN 'val' ELSE 'train' END AS split, to_json({{'instruction': instruction, 'input': '', 'output': output}})::VARCHAR AS line FROM r JOIN p USING (id)""")
def write_dataset(spark, d):
    """The split dataset written as JSON lines and read back."""
    path = _output(spark, "dataset")
    export.write_dataset(conversation_pairs(spark, d).orderBy("id"), path, "jsonl", "alpaca", 0.1)
    part = lambda x: spark.read.text(f"{path}_{x}").select(F.lit(x).alias("split"), F.col("value").alias("line"))
    return part("train").union(part("val"))


_STREAMED = ALL_SQL.replace("item_index % 3 = 2 AS task", "false AS task")


def _arrived(spark, d, files_: int) -> str:
    """Documents in a folder of so many files."""
    out = _output(spark, "stream")
    table(spark, d, "documents").select("doc_id", "text").repartition(files_).write.parquet(f"{out}/arrived")
    return out


def _digests(*names: str) -> list:
    return [F.md5(F.col(c).cast("binary")).alias(c) for c in names]


@query(f"{_STREAMED} SELECT doc_id, chunk_index::BIGINT AS chunk_index, item_index::BIGINT AS item_index, md5(instruction) AS instruction, md5(output) AS output, type FROM dp")
def stream_generate(spark, d):
    """Pairs of all documents, which arrive in a folder, generated as a stream and read back from the files it wrote."""
    out = _arrived(spark, d, 2)
    stream.stream_generate(spark, f"{out}/arrived", f"{out}/out", f"{out}/checkpoint").awaitTermination()
    got = stream.read_pairs(spark, f"{out}/out")
    return got.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("item_index").cast("long").alias("item_index"), *_digests("instruction", "output"), "type")


def _pair_service(messages, settings):
    """Answers with as many pairs as it is asked for, and fails on excerpts whose length divides by seven."""
    import json
    import re

    asked = messages[1]["content"]
    text = asked.split("DOCUMENT EXCERPT:\n", 1)[1].rsplit("\n---\n", 1)[0]
    if len(text) % 7 == 0:
        raise ValueError(f"HTTP 502 at {len(text)}")
    n, part, total = map(int, re.match(r"Generate exactly (\d+) .*?\(part (\d+) of (\d+)\)", asked).groups())
    item = lambda i: {"instruction": f"What is item {i} of part {part} of {total}?", "output": f"{len(text)} characters, {i} of {n}.", "type": "factual"}
    return json.dumps([item(i) for i in range(n)])


_SERVED = f"""WITH RECURSIVE {CHUNKS_SQL}, {SPECS_SQL},
served AS (
  SELECT doc_id, index AS chunk_index, item_index,
         'What is item ' || item_index || ' of part ' || (index + 1) || ' of ' || total || '?' AS instruction,
         length(text) || ' characters, ' || item_index || ' of ' || pairs || '.' AS output
  FROM s, unnest(range(0, pairs)) AS u(item_index) WHERE length(text) % 7 <> 0)"""


def _served(spark, d) -> str:
    out = _arrived(spark, d, 3)
    stream.stream_generate(spark, f"{out}/arrived", f"{out}/out", f"{out}/checkpoint", fn=_pair_service, files_a_batch=1).awaitTermination()
    return f"{out}/out"


@query(f"""{_SERVED} SELECT doc_id, chunk_index::INT AS chunk_index, item_index::INT AS item_index, md5(instruction) AS instruction, md5(output) AS output,
CASE WHEN length(output) < 20 THEN 'short_output' ELSE '' END AS codes FROM served""")
def stream_complete(spark, d):
    """Documents that arrive in three batches, to prompts, requests to a service, replies, flags and files."""
    codes = F.array_join("issues.code", ",").alias("codes")
    return stream.read_pairs(spark, _served(spark, d)).select("doc_id", "chunk_index", "item_index", *_digests("instruction", "output"), codes)


@query(f"""{_SERVED}, f AS (SELECT count(*) AS n_failed FROM s WHERE length(text) % 7 = 0)
SELECT count(*) AS n_pairs, count(*) FILTER (length(output) < 20) AS n_flagged, any_value(n_failed) AS n_failed, count(*) AS pairs_so_far FROM served, f""")
def stream_progress(spark, d):
    """What the batches counted while they wrote, added up, and the running count after the last."""
    told = stream.progress(spark, _served(spark, d))
    return told.agg(*(F.sum(c).alias(c) for c in stream.COUNTS), F.max("pairs_so_far").alias("pairs_so_far"))


@query(f"""{_SERVED.replace("WHERE length(text) % 7 <> 0", "")} SELECT doc_id, chunk_index::INT AS chunk_index, item_index::INT AS item_index, md5(instruction) AS instruction, md5(output) AS output FROM served""")
def recover_failed(spark, d):
    """A run in which some requests fail, and the pairs of a second run over those alone, appended."""
    ledger = _output(spark, "ledger")
    own = durable(specs(spark, d).withColumn("index", F.col("chunk_index")))

    def healthy(messages, settings):
        try:
            return _pair_service(messages, settings)
        except ValueError:
            text = messages[1]["content"].split("DOCUMENT EXCERPT:\n", 1)[1].rsplit("\n---\n", 1)[0]
            changed = [messages[0], messages[1] | {"content": messages[1]["content"].replace(text, text + "x", 1)}]
            return _pair_service(changed, settings).replace(f'"output": "{len(text) + 1} ', f'"output": "{len(text)} ')

    first = ledgers.complete_once(planning.build_prompts(own, ["factual"]).drop("text"), _pair_service, ledger)
    pairs, failures = generate.parse_responses(first.select(*generate.KEY, "response", "error"))
    whole, _ = ledgers.recover(pairs, own, failures, healthy, ledger, styles=["factual"])
    return whole.select("doc_id", "chunk_index", "item_index", *_digests("instruction", "output"))


_RAGGED = """concat(c_custkey, ',', '"', c_name, '""x"" ', chr(10), '", ', c_mktsegment, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN ',' WHEN 2 THEN ',,last"," one' ELSE concat(',', chr(13)) END,
CASE WHEN c_custkey % 5 = 0 THEN concat(chr(10), ' , ') ELSE '' END)"""


@query("""SELECT c_custkey, c_name || '"x" ' || chr(10) AS name, ' ' || c_mktsegment AS segment, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS n_cells, CASE WHEN c_custkey % 4 = 2 THEN 'last, one' END AS last FROM customer""")
def read_delimited(spark, d):
    """Customers written as delimited files with quotes, line feeds in cells, rows of three to five cells and blank rows, and read back."""
    out, c = _output(spark, "delimited"), table(spark, d, "customer")
    c.select(F.expr(_RAGGED.replace("chr(", "char(")).alias("value")).write.text(out)
    cell = lambda i: F.get("cells", F.lit(i))
    return files.read_delimited(spark, out).select(cell(0).cast(dict(c.dtypes)["c_custkey"]).alias("c_custkey"), cell(1).alias("name"), cell(2).alias("segment"), F.size("cells").alias("n_cells"), cell(4).alias("last"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 > 1 THEN trim(regexp_replace(c_name || ' & <' || c_mktsegment || '> ' || c_custkey, '\\s+', ' ', 'g')) END AS text,
CASE c_custkey % 7 WHEN 0 THEN 'malformed' WHEN 1 THEN 'no text' END AS reject_reason FROM customer""")
def xml_to_text(spark, d):
    """Customers as XML: one in seven is broken in one of three ways, and one in seven has no text."""
    broken = "CASE c_custkey % 3 WHEN 0 THEN '<c><n>x</c>' WHEN 1 THEN '<c>a & b</c>' ELSE '<c/><c/>' END"
    body = "concat('<c id=\"', c_custkey, '\"><n>', c_name, '</n> &amp;\\n<![CDATA[ <', c_mktsegment, '>]]>  <k>', c_custkey, '</k><!-- no --></c>')"
    xml = F.expr(f"CASE c_custkey % 7 WHEN 0 THEN {broken} WHEN 1 THEN '<c><n> </n></c>' ELSE {body} END")
    good, bad = files.xml_documents(table(spark, d, "customer").select("c_custkey", xml.alias("text")))
    return good.select("c_custkey", "text", F.lit(None).cast("string").alias("reject_reason")).union(bad.select("c_custkey", F.lit(None).cast("string"), "reject_reason"))


@query("""SELECT c_nationkey AS nation, md5(string_agg(c_name, chr(10) || ' ' ORDER BY c_custkey)) AS digest, 5 + sum(strlen(c_name) + 2)::BIGINT AS size FROM customer GROUP BY c_nationkey""")
def read_text_documents(spark, d):
    """Customers of each nation as a text file with blanks around, read back as a document."""
    out = _output(spark, "texts")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]), "\n ")
    lists = table(spark, d, "customer").groupBy("c_nationkey").agg(names.alias("names"))
    lists.select("c_nationkey", F.concat(F.lit("\n\t "), "names", F.lit(" \u00a0")).alias("value")).write.partitionBy("c_nationkey").text(out)
    nation = F.regexp_extract("path", "c_nationkey=(\\d+)", 1).cast(dict(table(spark, d, "customer").dtypes)["c_nationkey"])
    return files.read_text_documents(spark, out).select(nation.alias("nation"), F.md5(F.col("text").cast("binary")).alias("digest"), "size")


_VOICES = f"""voices AS (
  SELECT 0 AS v, 'NATION_3' AS name, {_quoted(planning.PERSONA_HEAD)} || ' NATION_3' || chr(10) || {" || chr(10) || ".join(_quoted(f"{label}: {value}.") for (_, label), value in zip(planning.PERSONA_LINES, ("changed", "", "", "", ""), strict=True))} AS persona
  UNION ALL SELECT 1, n_name, {_quoted(planning.PERSONA_HEAD)} || ' ' || n_name || chr(10) || {" || chr(10) || ".join(_quoted(f"{label}: ") + (" || 'region ' || n_regionkey" if not i else "") + " || '.'" for i, (_, label) in enumerate(planning.PERSONA_LINES))} FROM nation WHERE n_name = 'NATION_9'
  UNION ALL SELECT 2, 'Custom', {_quoted(planning.PERSONA_HEAD)} || chr(10) || 'a careful reader')"""
_VOICED = f"""WITH RECURSIVE {CHUNKS_SQL}, {_VOICES},
vs AS (
  SELECT doc_id, index, v, name, persona, text, least(total, 3) AS total, least(total, 3) * 3 AS slots, index * 3 + v AS slot FROM k, voices WHERE index < 3),
vp AS (SELECT *, 10 // slots + CASE WHEN slot < 10 % slots THEN 1 ELSE 0 END AS pairs FROM vs),
vq AS (SELECT doc_id, index, v, name, persona, pairs, {_CHUNK_PROMPT} FROM vp WHERE pairs > 0)"""


@query(f"""{_VOICED} SELECT doc_id, index::INT AS chunk_index, v::INT AS voice_index, pairs::INT AS pairs,
md5(system || chr(10) || chr(10) || persona || chr(10) || chr(10) || 'Ask and answer for this person without naming or addressing them; the facts stay those of the text.') AS system,
md5(regexp_replace(q, '^([^\n]*)', '\\1' || chr(10) || chr(10) || 'Every pair must be written from the point of view of: ' || name || '.')) AS user FROM vq""")
def voice_prompts(spark, d):
    """Voices end to end: chosen from the nations (one overridden, one unknown, one in free text), crossed with chunks, described and put into prompts."""
    n = table(spark, d, "nation")
    blank = [F.lit("").alias(c) for c in ("goal", "context", "expertise", "asks")]
    library = n.select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("summary"), F.concat(F.lit("region "), F.col("n_regionkey")).alias("role"), *blank)
    over = library.where("id = 'NATION_3'").select("id", *(F.lit("changed" if c == "role" else None).cast("string").alias(c) for c in planning.FIELDS))
    voices = planning.resolve_personas(library, ["NATION_3", "nowhere", "NATION_9", "custom"], over, " a careful reader ")
    voices = voices.select("voice_index", "id", planning.describe_persona().alias("persona"), F.col("name").alias("persona_name"))
    chunks = chunking.chunk_documents(table(spark, d, "documents").select("doc_id", "text"))
    prompts = planning.build_prompts(planning.build_specs(chunks, 10, voices), ["factual"], "basic")
    digest = lambda i: F.md5(F.col("messages")[i]["content"].cast("binary"))
    return prompts.select("doc_id", F.col("index").alias("chunk_index"), F.col("voice_index").cast("int").alias("voice_index"), "pairs", digest(0).alias("system"), digest(1).alias("user"))
