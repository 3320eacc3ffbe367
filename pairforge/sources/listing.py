"""Listings of files: kinds, exclusions, first choice, and folder trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pairforge.functions.indexing import written
from pairforge.functions.text import js_trim

#: Extensions by kind.
PROSE = ".txt .md .markdown .rst .adoc .asciidoc .tex .org .pdf .docx .epub .pptx .html .htm .xhtml .xml".split()
DATA = ".csv .tsv".split()
CODE = (
    ".py .js .mjs .cjs .jsx .ts .tsx .java .go .rs .c .h .cpp .hpp .cc .cs .rb .php .swift .kt .scala .r .lua .pl .dart .ex .exs .clj .hs "
    ".json .jsonl .ndjson .yaml .yml .toml .ini .cfg .conf .properties .sql .graphql .gql .proto .sh .bash .zsh .ps1 .bat .dockerfile .log"
).split()
BARE = "(?i)^(dockerfile|makefile|rakefile|gemfile|procfile)$"
#: What is kept out of a listing.
SECRET_DIRS = ".ssh .aws .gnupg .kube .docker".split()
NOISE_DIRS = (
    ".git .hg .svn node_modules bower_components vendor __pycache__ .venv venv env .tox .mypy_cache .pytest_cache dist build out target .next .nuxt "
    ".svelte-kit .parcel-cache .cache .turbo .gradle .idea .vscode coverage .terraform Pods DerivedData .DS_Store"
).split()
SECRET_EXTENSIONS = ".pem .key .p12 .pfx .keystore .jks .asc .gpg .kdbx .ppk".split()
SECRET_NAMES = (
    r"^\.env(\..*)?$", r"^\.?netrc$", r"^\.npmrc$", r"^\.pypirc$", r"^\.git-credentials$", r"^credentials(\.json|\.yml|\.yaml)?$",
    r"^secrets?\.(json|ya?ml|toml|ini|txt)$", r"^id_(rsa|dsa|ecdsa|ed25519)(\.pub)?$", r"^known_hosts$", r"^service[-_]?account.*\.json$",
    r"^.*[-_.](secret|secrets|credential|credentials|token|password)s?\.(json|ya?ml|toml|ini|txt|env)$",
)
REASONS = ("secret", "noise", "empty", "too-large", "unsupported")
MAX_BYTES = 5 * 1024 * 1024
MIN_CHARS = 25
NOMINAL_BYTES = 4096


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def kind(name: Column) -> Column:
    e = extension(name)
    return F.when(e.isin(PROSE), "prose").when(e.isin(DATA), "data").when(e.isin(CODE) | name.rlike(BARE), "code")


def assign_kind(files: DataFrame) -> DataFrame:
    return files.withColumn("kind", kind(F.col("name")))


def accept_documents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason) of files (name, text, …); accepted texts are trimmed."""
    text = js_trim(F.coalesce("text", F.lit("")))
    reason = F.when(F.col("kind").isNull(), "unsupported").when(F.length("text") < MIN_CHARS, "too-short")
    seen = files.withColumn("text", text).withColumn("kind", kind(F.col("name"))).withColumn("reject_reason", reason)
    return seen.where("reject_reason is null").drop("reject_reason"), seen.where("reject_reason is not null")


def classify_paths(listing: DataFrame) -> DataFrame:
    """Adds excluded, reason and detail to a listing (path, name, size); the first rule that holds decides."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    dirs = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    worst = F.get(F.filter(dirs, lambda d: d.isin(*SECRET_DIRS, *NOISE_DIRS)), F.lit(0))
    e = extension(F.col("name"))
    named = F.col("name").rlike("(?i)" + "|".join(f"(?:{p})" for p in SECRET_NAMES))
    rules = [
        (F.col("_d").isin(SECRET_DIRS), "secret", F.concat(F.lit("inside "), "_d", F.lit("/"))),
        (F.col("_d").isNotNull(), "noise", F.concat(F.lit("inside "), "_d", F.lit("/"))),
        (F.col("_e").isin(SECRET_EXTENSIONS), "secret", F.concat("_e", F.lit(" key or certificate"))),
        (named, "secret", F.col("name")),
        (F.col("size") == 0, "empty", F.lit(None).cast("string")),
        (F.col("size") > MAX_BYTES, "too-large", F.concat(F.format_string("%.1f", F.col("size") / 1048576), F.lit(" MB"))),
        (kind(F.col("name")).isNull(), "unsupported", F.when(F.col("_e") == "", "no extension").otherwise(F.col("_e"))),
    ]
    reason, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, why, what in reversed(rules):
        reason, detail = F.when(when, why).otherwise(reason), F.when(when, what).otherwise(detail)
    seen = listing.withColumn("_d", worst).withColumn("_e", e).withColumn("reason", reason).withColumn("detail", detail)
    return seen.withColumn("excluded", F.col("reason").isNotNull()).drop("_d", "_e")


def partition_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(included, excluded, files by reason)."""
    seen = classify_paths(listing)
    out = seen.where("excluded")
    return seen.where("not excluded").drop("excluded", "reason", "detail"), out, out.groupBy("reason").agg(F.count("*").alias("n"))


def partition_written(listing: DataFrame, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The same with one pass: the classified listing is written under ``path``, and counts by reason are observed on the way."""
    tally = Observation()
    counts = (F.count_if(F.col("reason") == r).alias(r) for r in REASONS)
    classify_paths(listing).observe(tally, *counts).write.partitionBy("excluded").parquet(path)
    seen = listing.sparkSession.read.parquet(path)
    by_reason = {r: n for r, n in tally.get.items() if n}
    return seen.where("excluded = 'false'").drop("excluded", "reason", "detail"), seen.where("excluded = 'true'").withColumn("excluded", F.lit(True)), by_reason


def select_first(listing: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` by path (ties by id, where there is one): a top-k, as the feature asks."""
    return listing.orderBy("path", *(c for c in ("id",) if c in listing.columns)).limit(n)


def render_records(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(n, text): each row as ``Record n`` and a line for each cell that is not blank, numbered in ``order``."""
    from pairforge.functions.indexing import dense_index

    cell = lambda c: F.when(js_trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), js_trim(F.col(c).cast("string"))))
    return dense_index(rows, order, "_n").select((F.col("_n") + 1).alias("n"), F.concat_ws("\n", F.concat(F.lit("Record "), (F.col("_n") + 1).cast("string")), *map(cell, columns)).alias("text"))


def listing_paths(nodes: DataFrame) -> DataFrame:
    """(id, path, name, size): full paths of the files of a folder tree (id, parent_id, name, mime, size, is_folder).

    Each node knows an ancestor and the path from below it; in every round it takes over its ancestor's
    ancestor and path, so the ways double and rounds grow with the logarithm of the depth. Nodes whose
    way up ends at no root (a missing parent, a parent that is no folder, a ring) have no path.
    """
    native = F.when(F.col("mime").endswith("document"), ".txt").when(F.col("mime").endswith("spreadsheet"), ".csv").otherwise("")
    native = F.when(F.col("mime").startswith("application/vnd.google-apps."), native).otherwise("")
    shown = nodes.withColumn("name", F.concat("name", F.when(F.col("is_folder"), "").otherwise(native)))
    state = written(shown.select("id", F.col("parent_id").alias("up"), F.col("name").alias("path"), "is_folder"), "tree")
    waiting = state.where("up is not null").count()
    while waiting:
        above = state.where("is_folder").select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        way = state.where("up is not null").join(above, F.col("up") == F.col("_id")).select("id", F.col("_up").alias("up"), F.concat_ws("/", "_path", "path").alias("path"), "is_folder")
        state = written(state.where("up is null").unionByName(way), "tree")
        left = state.where("up is not null").count()
        if left == waiting:  # every open way up that ends passes a node that ends in this round: these are rings
            break
        waiting = left
    size = F.when(F.coalesce("size", F.lit(0)) == 0, F.lit(NOMINAL_BYTES)).otherwise(F.col("size")).cast("long")
    return state.where("up is null and not is_folder").select("id", "path").join(shown.select("id", "name", size.alias("size")), "id")
