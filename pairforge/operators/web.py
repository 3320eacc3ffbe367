"""Stored web pages: canonical URLs, robots rules, links, a bounded crawl and readable text."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.indexing import written
from pairforge.functions.text import WHITE, js_trim, let

#: Parameters that do not tell pages apart.
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id gclid fbclid msclkid igshid mc_cid mc_eid ref ref_src referrer _ga yclid spm".split()
#: Parts of content types, in order, and their extensions (one page; a crawl).
PAGE_TYPES = (
    ("text/html", ".html"), ("application/xhtml", ".html"), ("application/pdf", ".pdf"), ("text/markdown", ".md"), ("text/csv", ".csv"), ("text/tab-separated-values", ".tsv"),
    ("application/json", ".json"), ("application/xml", ".xml"), ("text/xml", ".xml"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".docx"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", ".pptx"), ("application/epub+zip", ".epub"), ("text/plain", ".txt"),
)
CRAWL_TYPES = tuple((t, e) for t, e in PAGE_TYPES if e in (".html", ".pdf", ".md", ".csv", ".json", ".txt"))
NOISE = frozenset("script style noscript nav header footer aside iframe svg form button".split())
BLOCKS = frozenset("p div section li tr h1 h2 h3 h4 h5 h6 br".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


#: Characters that are percent-encoded in a path, a query and a fragment, as classes of regular expressions.
_IN_PATH, _IN_QUERY, _IN_FRAGMENT = (rf"\x00-\x20\x7f-\x{{10ffff}}\"<>{own}" for own in ("`{}^", "'", "`"))
_DOT = r"(?:\.|%2[eE])"


def _encoded(text: Column, bad: str) -> Column:
    """``text`` with each character of the class ``bad`` as the percent-encoded bytes of its UTF-8."""
    one = lambda c: F.when(c.rlike(f"[{bad}]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    return F.when(text.rlike(f"[{bad}]"), F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), 0), one), "")).otherwise(text)


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, its dot segments resolved: each of two dots takes the segment before off the stack."""
    parts = F.transform(
        F.split(F.substring(path, 2, 2147483647), "/"),
        lambda s: F.struct(s.alias("s"), s.rlike(f"^{_DOT}$").alias("here"), s.rlike(f"^{_DOT}{_DOT}$").alias("up")),
    )
    push = lambda stack, x: F.when(x["up"], F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))).when(x["here"], stack).otherwise(F.concat(stack, F.array(x["s"])))
    kept = F.aggregate(parts, F.array().cast("array<string>"), push)
    ends = path.rlike(f"/{_DOT}{{1,2}}$")  # what a last dot segment leaves is a folder
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(path.rlike(f"/{_DOT}{{1,2}}(/|$)"), F.when(ends & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)).otherwise(path)


def _parsed(url: Column) -> Column:
    """(scheme, user, host, port, path, query, fragment) of an http address as browsers read it, null if it is none.

    Scheme and host are in lower case, a default port is dropped, dot segments are
    resolved, characters that may not stand are percent-encoded, and query and
    fragment are null where there are none. Names beyond ASCII stay as they are
    (no punycode), and numbers for hosts are not read as IPv4.
    """
    text = F.translate(js_trim(F.coalesce(url, F.lit(""))), "\t\n\r", "")
    before, fragment = F.regexp_extract(text, "(?s)^([^#]*)", 1), F.regexp_extract(text, "(?s)#(.*)$", 1)
    whole = r"(?is)^(https?):[/\\\\]*([^/\\\\?]*)([^?]*)"
    part = lambda i: F.regexp_extract(before, whole, i)
    host = F.regexp_extract(part(2), r"(?s)([^@]*)$", 1)
    raw = let(
        F.struct(
            F.lower(part(1)).alias("scheme"),
            F.regexp_extract(part(2), "(?s)^(.*)@", 1).alias("user"),
            F.lower(F.regexp_extract(host, r"(?s)^(\[.*\]|[^:]*)", 1)).alias("host"),
            F.regexp_extract(host, r"(?s)^(?:\[.*\]|[^:]*):(.*)$", 1).alias("port"),
            F.translate(part(3), "\\", "/").alias("path"),
        ),
        lambda x: F.struct(
            x["scheme"].alias("scheme"),
            x["user"].alias("user"),
            F.when(x["host"].contains("%"), F.lower(F.try_url_decode(F.replace(F.regexp_replace(x["host"], "%(?![0-9a-fA-F]{2})", "%25"), F.lit("+"), F.lit("%2B"))))).otherwise(x["host"]).alias("host"),
            F.regexp_replace(x["port"], "^0+(?=.)", "").alias("port"),
            _encoded(_without_dots(F.when(x["path"] == "", "/").otherwise(x["path"])), _IN_PATH).alias("path"),
        ),
    )
    named = lambda x: (x["host"] != "") & (x["host"].rlike(r"^\[[0-9a-f:.]+\]$") | ~x["host"].rlike(r"[\x00-\x20\"#%/:<>?@\[\]\\^`{|}\x7f]"))
    ported = lambda x: x["port"].rlike("^[0-9]{0,5}$") & (F.coalesce(x["port"].try_cast("int"), F.lit(0)) <= 65535)
    return let(
        raw,
        lambda x: F.when(
            before.rlike("(?i)^https?:") & named(x) & ported(x),
            F.struct(
                x["scheme"].alias("scheme"),
                x["user"].alias("user"),
                x["host"].alias("host"),
                F.when((x["port"] == "") | ((x["scheme"] == "http") & (x["port"] == "80")) | ((x["scheme"] == "https") & (x["port"] == "443")), "").otherwise(F.concat(F.lit(":"), x["port"])).alias("port"),
                x["path"].alias("path"),
                F.when(before.contains("?"), _encoded(F.regexp_extract(before, r"(?s)\?(.*)$", 1), _IN_QUERY)).alias("query"),
                F.when(text.contains("#"), _encoded(fragment, _IN_FRAGMENT)).alias("fragment"),
            ),
        ),
    )


def _parts(url: Column) -> tuple[Column, Column]:
    """Host with port, and path."""
    at = lambda f: let(_parsed(url), f)
    return at(lambda x: F.concat(x["host"], x["port"])), at(lambda x: x["path"])


def _given(mark: str, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit(mark), text), F.lit(""))


def canonical_url(url: Column) -> Column:
    """The address as browsers write it, null for what is none."""
    user = lambda x: F.when(x["user"].rlike("^:?$"), "").otherwise(F.concat(x["user"], F.lit("@")))
    return let(_parsed(url), lambda x: F.concat(x["scheme"], F.lit("://"), user(x), x["host"], x["port"], x["path"], _given("?", x["query"]), _given("#", x["fragment"])))


def normalize_url(raw: Column) -> Column:
    """The address that was meant, https by default; null if it is none: blank, with spaces, another scheme, credentials, or a bare word."""
    t = js_trim(F.coalesce(raw, F.lit("")))
    has = t.rlike("(?i)^[a-z][a-z0-9+.-]*://")
    bad = (t == "") | t.rlike(WHITE) | (has & ~t.rlike("(?i)^https?://"))
    meant = F.when(has, t).otherwise(F.concat(F.lit("https://"), t))
    good = lambda x: ~bad & x["user"].rlike("^:?$") & (x["host"].contains(".") | (x["host"] == "localhost"))
    return let(_parsed(meant), lambda x: F.when(good(x), F.concat(x["scheme"], F.lit("://"), x["host"], x["port"], x["path"], _given("?", x["query"]), _given("#", x["fragment"]))))


def _form(query: Column) -> Column:
    """A query's parameters read and written as forms are, without those that track, sorted by name (ties as they stood)."""
    read = lambda t: F.try_url_decode(F.regexp_replace(t, "%(?![0-9a-fA-F]{2})", "%25"))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p, i: F.struct(read(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), read(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda x: ~x["k"].isin(TRACKING)))
    return F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")


def url_dedupe_key(url: Column) -> Column:
    """One key for all addresses of a page, null for what is no address: no fragment, no tracking, parameters decoded, sorted and encoded one way, no trailing slash."""
    user = lambda x: F.when(x["user"].rlike("^:?$"), "").otherwise(F.concat(x["user"], F.lit("@")))
    path = lambda x: F.when(F.length(x["path"]) > 1, F.regexp_replace(x["path"], "/$", "")).otherwise(x["path"])
    query = lambda x: let(_form(F.coalesce(x["query"], F.lit(""))), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return let(_parsed(url), lambda x: F.concat(x["scheme"], F.lit("://"), user(x), x["host"], x["port"], path(x), query(x)))


def content_type_ext(content_type: Column, types: tuple[tuple[str, str], ...] = PAGE_TYPES) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return F.coalesce(*(F.when(ct.contains(t), F.lit(e)) for t, e in types))


def page_name(url: Column, ext: Column, n: Column | None = None) -> Column:
    """The last path segment (else the host) without its extension; with ``n``, a number of two digits or more before."""
    host, path = _parts(url)
    host = F.regexp_replace(host, ":[0-9]*$", "")
    last = F.element_at(F.filter(F.split(path, "/"), lambda s: s != ""), -1)
    last = F.when(F.size(F.filter(F.split(path, "/"), lambda s: s != "")) > 0, last).otherwise(host)
    stem = F.regexp_replace(last, r"(?i)\.[a-z0-9]{1,8}\z", "")
    stem = F.when(stem == "", host if n is None else F.lit("page")).otherwise(stem)
    if n is None:
        return F.concat(stem, ext)
    text = n.cast("string")
    return F.concat(F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text), F.lit("-"), stem, ext)


def parse_robots(files: DataFrame) -> DataFrame:
    """(site, allow, path): the rules under ``User-agent: *`` of each robots file (site, text)."""
    lines = files.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "raw"))
    line = js_trim(F.substring_index("raw", "#", 1))
    cut = lines.select("site", "n", F.lower(js_trim(F.substring_index(line, ":", 1))).alias("field"), js_trim(F.when(line.contains(":"), F.regexp_replace(line, "^[^:]*:", "")).otherwise("")).alias("value"))
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("site").orderBy("n"))
    return cut.withColumn("agent", agent).where("agent = '*' and value <> '' and field in ('allow', 'disallow')").select("site", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds allowed to urls (site, path, …): the longest matching rule decides, Allow among equals, and none allows."""
    asked = urls.select("site", "path").distinct()
    # a site has few lengths of rules: the path's beginning of each is looked up among the rules
    lengths = rules.select("site", F.length("path").alias("n")).distinct()
    begins = asked.join(lengths, "site").where(F.length("path") >= F.col("n")).select("site", "path", F.col("path").substr(F.lit(1), F.col("n")).alias("rule"))
    best = begins.join(rules.select("site", F.col("path").alias("rule"), "allow"), ["site", "rule"]).groupBy("site", "path").agg(F.max_by("allow", F.struct(F.length("rule"), "allow")).alias("allowed"))
    return urls.join(best, ["site", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True))).select(*urls.columns, "allowed")


class _Text(HTMLParser):
    """Text of the first article, else main, else role=main, else all; noise is left out, blocks end with a line feed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []
        self.muted = 0
        self.out: list[str] = []
        self.roots: dict[str, tuple[int, int]] = {}

    def _close(self, i: int) -> None:
        for tag, root in reversed(self.open[i:]):
            if tag in NOISE:
                self.muted -= 1
            elif tag in BLOCKS and not self.muted:
                self.out.append("\n")
            for name, (a, b) in list(self.roots.items()):
                if b < 0 and root and name in self._names(tag, root):
                    self.roots[name] = (a, len(self.out))
        del self.open[i:]

    @staticmethod
    def _names(tag: str, root: int) -> tuple[str, ...]:
        return tuple(n for n, bit in (("article", 1), ("main", 2), ("role", 4)) if root & bit)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _CLOSES_P and any(t == "p" for t, _ in self.open):
            self._close(max(i for i, (t, _) in enumerate(self.open) if t == "p"))
        elif tag == "li" and any(t == "li" for t, _ in self.open):
            last = max(i for i, (t, _) in enumerate(self.open) if t == "li")
            if not any(t in ("ul", "ol") for t, _ in self.open[last:]):
                self._close(last)
        if tag in VOID:
            if tag in BLOCKS and not self.muted:
                self.out.append("\n")
            return
        if tag in NOISE:
            self.muted += 1
        root = 0
        if not self.muted:
            for name, bit, here in (("article", 1, tag == "article"), ("main", 2, tag == "main"), ("role", 4, dict(attrs).get("role") == "main")):
                if here and name not in self.roots:
                    self.roots[name] = (len(self.out), -1)
                    root |= bit
        self.open.append((tag, root))

    def handle_endtag(self, tag: str) -> None:
        at = [i for i, (t, _) in enumerate(self.open) if t == tag]
        if at:
            self._close(at[-1])

    def handle_data(self, data: str) -> None:
        if not self.muted and not any(t in ("head", "title") for t, _ in self.open):
            self.out.append(data)

    def text(self) -> str:
        self._close(0)
        for name in ("article", "main", "role"):
            if name in self.roots:
                a, b = self.roots[name]
                return "".join(self.out[a : b if b >= 0 else None])
        return "".join(self.out)


@F.pandas_udf(T.StringType())
def _html_text(html: pd.Series) -> pd.Series:
    def one(x: str | None) -> str:
        p = _Text()
        p.feed(x or "")
        p.close()
        return p.text()

    return html.map(one)


def html_to_text(html: Column) -> Column:
    squeezed = F.regexp_replace(F.regexp_replace(_html_text(html), "[ \\t\\u00a0]+", " "), "\n{3,}", "\n\n")
    return js_trim(F.regexp_replace(squeezed, "(?m)^[ \\t]+|[ \\t]+$", ""))


class _Links(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.robots, self.found = None, None, []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        if tag == "base" and self.base is None and a.get("href") is not None:
            self.base = a["href"]
        elif tag == "meta" and (a.get("name") or "").lower() == "robots" and self.robots is None:
            self.robots = (a.get("content") or "").lower()
        elif tag == "a" and a.get("href") and not a["href"].startswith("#") and "nofollow" not in (a.get("rel") or "").lower():
            self.found.append(a["href"])


@F.pandas_udf(T.StructType([T.StructField("noindex", T.BooleanType()), T.StructField("nofollow", T.BooleanType()), T.StructField("links", T.ArrayType(T.StringType()))]))
def _links(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    def one(u: str | None, h: str | None) -> tuple[bool, bool, list[str]]:
        p = _Links()
        p.feed(h or "")
        robots, out = p.robots or "", []
        origin = urlsplit(u or "")
        for href in [] if "nofollow" in robots else p.found:
            try:
                there = urlsplit(re.sub("#.*$", "", urljoin(urljoin(u or "", p.base or ""), href)))
                if (there.scheme, there.netloc.lower()) == (origin.scheme, origin.netloc.lower()) and there.scheme in ("http", "https"):
                    out.append(there._replace(path=there.path or "/").geturl())
            except ValueError:
                continue
        return "noindex" in robots, "nofollow" in robots, out

    return pd.DataFrame([one(u, h) for u, h in zip(url, html, strict=True)], columns=["noindex", "nofollow", "links"])


def extract_links(pages: DataFrame) -> DataFrame:
    """(url, noindex, nofollow, pos, key, href) of pages (url, html): same-origin links, a row for each key; first place, last address. A page without links has one row with null key."""
    read = pages.select("url", _links("url", "html").alias("l"))
    every = read.select("url", "l.noindex", "l.nofollow", F.posexplode_outer("l.links").alias("pos", "_raw")).withColumn("href", F.coalesce(canonical_url(F.col("_raw")), "_raw")).withColumn("key", url_dedupe_key(F.col("href")))
    return every.groupBy("url", "noindex", "nofollow", "key").agg(F.min("pos").alias("pos"), F.max_by("href", "pos").alias("href")).select("url", "noindex", "nofollow", "pos", "key", "href")


def dedupe_pages(pages: DataFrame) -> DataFrame:
    """One page for each key, the first by page_id."""
    keyed = pages.withColumn("key", url_dedupe_key(F.col("url")))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))
    return keyed.join(first, ["key", "page_id"], "left_semi")


def _counted(level: DataFrame, before: DataFrame | None) -> DataFrame:
    """Adds had: how many rows of the site without a reason stand before a row in order of place, those of ``before`` (site, had) included.

    In two steps: rows are range-partitioned by site and place and counted inside each
    range, and a row for each range and site tells what stood in the ranges before. A
    site of any size is spread over all ranges.
    """
    n = int(level.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    good = F.when(F.col("reason").isNull(), 1).otherwise(0)
    ranged = written(level.repartitionByRange(n, "site", "place").withColumn("_range", F.spark_partition_id()), "level")
    sums = ranged.groupBy("_range", "site").agg(F.sum(good).alias("_n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_range", "site", F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("site").orderBy("_range"))), F.lit(0)).alias("_offset"))  # a row a range
    inside = F.coalesce(F.sum(good).over(earlier(Window.partitionBy("_range", "site").orderBy("place"))), F.lit(0))
    out = ranged.withColumn("had", inside).join(offsets, ["_range", "site"])
    had = F.col("had") + F.col("_offset")
    if before is not None:
        out, had = out.join(before.withColumnRenamed("had", "_before"), "site", "left"), had + F.coalesce("_before", F.lit(0))
    return out.withColumn("had", had).select(*level.columns, "had")


def crawl_pages(pages: DataFrame, rules: DataFrame, starts: DataFrame, max_depth: int = 1, max_pages: int = 25) -> tuple[DataFrame, DataFrame]:
    """(imported, skipped) of a breadth-first walk over stored pages (url, content_type, html) from starts (site, url).

    imported: site, n, url, ext, name; skipped: site, url, reason, detail. At most ``max_pages`` are imported a site;
    what lies beyond in the queue is neither imported nor reported. A page is parsed when the walk reaches it: each level
    meets the stored pages by key, and only the HTML of its own pages is read for links. Addresses that are none are left out.
    """
    keyed = pages.select("url", "content_type", "html", url_dedupe_key(F.col("url")).alias("key")).where("key is not null")
    stored = written(keyed.join(keyed.groupBy("key").agg(F.min("url").alias("url")), ["key", "url"], "left_semi").dropDuplicates(["key"]), "stored")
    frontier = written(starts.select("site", "url", url_dedupe_key(F.col("url")).alias("key"), F.array(F.lit(0)).alias("place")).where("key is not null"), "frontier")
    seen = frontier.select("site", "key")
    imported = skipped = None
    for depth in range(max_depth + 1):
        path = F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1)
        asked = robots_allowed(frontier.withColumn("path", F.when(path == "", "/").otherwise(path)), rules)
        ext = content_type_ext(F.col("content_type"), CRAWL_TYPES)
        got = written(asked.join(stored.select("key", "content_type"), "key", "left").withColumn("ext", ext), "asked")
        reached = got.where("allowed and ext = '.html'").select("key").distinct()
        links = written(extract_links(stored.join(reached, "key", "left_semi").select("url", "html")).join(stored.select("url", F.col("key").alias("from_key")), "url"), "links")
        flags = links.select(F.col("from_key").alias("key"), "noindex").distinct()
        reason = F.when(~F.col("allowed"), "robots").when(F.col("content_type").isNull(), "fetch-error").when(F.col("ext").isNull(), "unsupported").when(F.coalesce("noindex", F.lit(False)), "noindex")
        told = got.join(flags, "key", "left").withColumn("reason", reason)
        before = None if imported is None else imported.groupBy("site").agg(F.count("*").alias("had"))
        level = written(_counted(told, before).where(F.col("had") < max_pages), "counted")
        new = level.where("reason is null").select("site", (F.col("had") + 1).alias("n"), "url", "ext")
        out = level.where("reason is not null").select("site", "url", "reason", F.when(F.col("reason") == "unsupported", F.substring_index("content_type", ";", 1)).alias("detail"))
        imported = new if imported is None else imported.unionByName(new)
        skipped = out if skipped is None else skipped.unionByName(out)
        if depth == max_depth:
            break
        followed = level.where("ext = '.html' and (reason is null or reason = 'noindex')").select("site", F.col("key").alias("from_key"), "place")
        next_ = followed.join(links.where("key is not null").select("from_key", "key", "href", "pos"), "from_key").select("site", "key", F.col("href").alias("url"), F.concat("place", F.array("pos")).alias("place"))
        first = next_.groupBy("site", "key").agg(F.min(F.struct("place", "url")).alias("f")).select("site", "key", "f.url", "f.place")
        frontier = written(first.join(seen, ["site", "key"], "left_anti"), "frontier")
        seen = seen.union(frontier.select("site", "key"))
    return imported.withColumn("name", page_name(F.col("url"), F.col("ext"), F.col("n"))), skipped
