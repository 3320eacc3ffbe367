"""Fixtures and brute-force models of the pair-making operators."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairforge.functions.text import normalise
from pairforge.operators import chunking, curate, dedup, generate, planning, pricing, quality, similar, web
from pairforge.sources import export, files, listing
from pairforge.streaming.generate import pairs_of, read_pairs, stream_generate


def grams(x):
    return {x} if 0 < len(x) < 3 else {x[i : i + 3] for i in range(len(x) - 2)}


def near(a, b, t):
    a, b = grams(a), grams(b)
    return True if not a and not b else len(a & b) / len(a | b) >= t


@pytest.mark.parametrize(("seed", "shared", "room"), [(1, 1, 300_000), (2, 1, 150), (3, 2, 300)])
def test_greedy_near_duplicates_equal_the_sequential_rule(spark, monkeypatch, seed, shared, room):
    """Over one range or many, with keys of one gram or of two."""
    monkeypatch.setattr(similar, "RANGE_PAIRS", room)
    monkeypatch.setattr(similar, "ROW_PAIRS", 1)
    monkeypatch.setattr(similar, "shared_grams", lambda sets, t: (shared, 1e9))
    monkeypatch.setattr(similar, "TASK_EDGES", 0 if seed == 3 else 500_000)
    rng = random.Random(seed)
    base = ["what is the colour of the sky at noon", "how do plants turn light into sugar", "ab", ""]
    texts = []
    for _ in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("abcxyz")
        texts.append("".join(t))
    kept, want, seen = [], {}, {}
    for i, t in enumerate(texts):
        if t and t in seen:
            want[i] = seen[t]
        elif t:
            seen[t] = i
    for i, t in enumerate(texts):
        if i in want:
            continue
        hit = next((k for k in kept if near(texts[k], t, 0.7)), None)
        if hit is None:
            kept.append(i)
        else:
            want[i] = hit
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id int, ord int, instruction string")
    got = {r.dup_id: r.keep_id for r in dedup.find_duplicates(df, 0.7).collect()}
    assert got == want
    if seed > 1:
        return
    assert dedup.remove_duplicates(df, dedup.find_duplicates(df, 0.7)).count() == len(texts) - len(want)


def test_edges_are_all_similar_pairs_by_either_kind_of_key(spark, monkeypatch):
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("ab c") for _ in range(rng.choice([1, 2, 3, 4, 30]))) for _ in range(70)} | {" ".join(rng.choices(["red", "green", "blue", "grey"], k=5)) for _ in range(50)})
    df = spark.createDataFrame([(f"r{i}", i, t) for i, t in enumerate(texts)], "id string, ord int, instruction string")
    norm = {f"r{i}": " ".join(t.split()) for i, t in enumerate(texts)}
    first = {}
    for k, t in norm.items():
        first.setdefault(t or k, k)
    own = [k for k, t in norm.items() if first[t or k] == k]
    empty = [k for k in own if not norm[k]]
    want = {(a, b) for x, a in enumerate(own) for b in own[x + 1 :] if norm[a] and norm[b] and near(norm[a], norm[b], 0.6)} | {(empty[0], b) for b in empty[1:]}
    monkeypatch.setattr(similar, "BLOCK_ROWS", 5)  # keys of more rows are split
    for shared in (1, 2):
        monkeypatch.setattr(similar, "shared_grams", lambda sets, t, shared=shared: (shared, 1e9))
        assert {(r.i, r.j) for r in dedup.near_duplicate_edges(df, 0.6).collect()} == want


def test_duplicates_among_generated_pairs_equal_the_sequential_rule(spark):
    from pairforge.plans.inputs import document_pairs

    pairs = document_pairs(spark, "/root/testdata/sf0.001").withColumn("ord", F.col("id"))
    rows = pairs.select("id", normalise(F.col("instruction")).alias("key")).orderBy("id").collect()
    first, want, kept = {}, {}, []
    for r in rows:
        if r.key in first:
            want[r.id] = (first[r.key], "exact")
        else:
            first[r.key] = r.id
    for r in rows:
        if r.id not in want:
            own = grams(r.key)
            hit = next((k for k, other in kept if len(own & other) / len(own | other) >= 0.8), None)
            if hit is None:
                kept.append((r.id, own))
            else:
                want[r.id] = (hit, "fuzzy")
    assert {r.dup_id: (r.keep_id, r.match_kind) for r in dedup.find_duplicates(pairs, 0.8).collect()} == want
    assert {"exact", "fuzzy"} == {kind for _, kind in want.values()}


def test_a_family_leaves_by_its_first_row(spark, monkeypatch):
    base, rng = "what is the colour of the sky at noon over the old harbour", random.Random(6)
    rows = [base[: (k := rng.randrange(len(base)))] + rng.choice("abcxyz") + base[k + 1 :] for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(rows)), "ord int, instruction string").withColumn("id", F.col("ord"))
    monkeypatch.setattr(similar, "RANGE_PAIRS", 20_000)
    made = []
    monkeypatch.setattr(similar, "settled", lambda edges, f=similar.settled: (made.append(edges.count()), f(edges))[1])
    found = dedup.find_duplicates(df, 0.7)
    assert found.count() == 599 and found.where("match_kind = 'fuzzy'").select("keep_id").distinct().count() == 1
    assert sum(made) < 10_000  # of 179,700 pairs


def test_chunk_boundaries():
    assert chunking.spans("", 10, 2, False) == [(0, 0)]
    assert chunking.spans("x" * 25, 10, 3, False) == [(0, 10), (7, 17), (14, 24), (21, 25)]
    assert chunking.spans("aaaaaaaa. bbbbbbbbbb", 10, 2, False)[0] == (0, 10)
    assert chunking.spans("aaaaaaaaa. bbbbbbbbbb", 10, 2, False)[0] == (0, 11)  # a mark may begin before the end and reach past it
    assert chunking.spans("aaaaaaaaaa. bbbbbbbbbb", 10, 2, False)[0] == (0, 12)
    assert chunking.spans("aaaaaaaa\nb cccccccccc", 10, 2, True)[0] == (0, 9)
    assert chunking.spans("aaaaaaaa\n  cccccccccc", 10, 2, True)[0] == (0, 9)


def test_quality_codes(spark):
    rows = [("", "", "factual"), ("What is it?", "It is a thing that is long enough and ends", "factual"), ("Explain this now", "Explain this now", "odd"), ("What is ozone?", "According to the document it is a gas.", "factual")]
    got = [[i.code for i in r.issues] for r in quality.validate_pairs(spark.createDataFrame(rows, "instruction string, output string, type string")).collect()]
    assert got == [["empty_instruction", "empty_output"], ["truncated_output"], ["short_output", "echo", "bad_type"], ["source_leak"]]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 25])
def test_split(spark, n):
    got = sorted(r.id for r in export.split_train_val(spark.range(n), 0.1, ["id"]).where("split = 'val'").collect())
    m = max(1, int(n * 0.1 + 0.5)) if n else 0
    assert got == sorted({min(n - 1, int(k * (n / m) + n / m / 2)) for k in range(m)})


def test_replies():
    item = '{"instruction": "q", "output": "a", "type": "instruction", "x": 1}'
    want = [{"instruction": "q", "output": "a", "type": "instruction"}]
    for raw in (f"[{item}]", f"```json\n[{item}]\n```", f"Here: [{item}] done", f'{{"pairs": [{item}]}}'):
        assert generate.read_reply(raw) == want
    assert generate.read_reply("[]") == []
    assert generate.read_reply('[{"instruction": 1, "output": "a"}]') == []
    assert generate.read_reply("[null]") is None
    assert generate.read_reply('[{"instruction": "q"') is None
    assert generate.read_reply("[NaN]") is None


def test_listing_rules(spark):
    rows = [("project/README.md", 9, None), (".env", 9, "secret"), ("a/credentials.json", 9, "secret"), ("server.pem", 9, "secret"), ("node_modules/.ssh/x.txt", 9, "noise"), (".ssh/config", 9, "secret"), ("logo.png", 9, "unsupported"), ("empty.md", 0, "empty"), ("huge.txt", 6 << 20, "too-large"), ("x/Makefile", 9, None)]
    df = spark.createDataFrame([(p, p.split("/")[-1], s) for p, s, _ in rows], "path string, name string, size long")
    got = {r.path: r.reason for r in listing.classify_paths(df).collect()}
    assert got == {p: w for p, _, w in rows}


def test_urls(spark):
    cases = {"example.com": "https://example.com/", "localhost:8080/page.html": "https://localhost:8080/page.html", "ftp://x.com": None, "file:///x": None, "javascript:alert(1)": None, "word": None, "  ": None, "not a url": None, "mailto:a@b.com": None}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    assert {r.raw: r.u for r in df.withColumn("u", web.normalize_url(F.col("raw"))).collect()} == cases
    pairs = [("https://x.com/a#b", "https://x.com/a", True), ("https://x.com/?utm_source=q", "https://x.com/", True), ("https://x.com/?b=1&a=2", "https://x.com/?a=2&b=1", True), ("https://x.com/d/", "https://X.com/d", True), ("https://x.com/?id=1", "https://x.com/?id=2", False)]
    df = spark.createDataFrame(pairs, "a string, b string, same boolean")
    assert all(r.same == r.got for r in df.withColumn("got", web.url_dedupe_key(F.col("a")) == web.url_dedupe_key(F.col("b"))).collect())


def test_addresses_are_read_as_browsers_do(spark):
    cases = {
        "https://example.com/a/../b/./c": "https://example.com/b/c", "https://x.com/a/b/..": "https://x.com/a/", "https://x.com/a/.": "https://x.com/a/", "https://x.com/../../a": "https://x.com/a", "https://x.com/a/%2E%2e/b": "https://x.com/b",
        "https://x.com/..a/.b/...": "https://x.com/..a/.b/...", "http:example.com": "http://example.com/", "https:\\\\x.com\\a\\..\\b": "https://x.com/b", "HTTP://X.com:80": "http://x.com/", "https://x.com:0443/": "https://x.com/", "https://x.com:8080?q": "https://x.com:8080/?q",
        "https://x.com/a b\"<>`{}é^|": "https://x.com/a%20b%22%3C%3E%60%7B%7D%C3%A9%5E|", "https://x.com/?a b'é`": "https://x.com/?a%20b%27%C3%A9`", "https://x.com/#a b`'": "https://x.com/#a%20b%60'", "https://x.com/%7e%zz": "https://x.com/%7e%zz",
        "https://x.com/?": "https://x.com/?", "https://x.com#": "https://x.com/#", "https://[::1]:9/": "https://[::1]:9/", "https://@x.com": "https://x.com/", "https://u:p@x.com/": "https://u:p@x.com/", "https://%65x.com/": "https://ex.com/", "https://x.com/😀": "https://x.com/%F0%9F%98%80",
        "https://x y.com/": None, "https://x.com:99999/": None, "https://x.com:8a/": None, "https://": None, "mailto:a@b.com": None, "/a": None, "": None, "https://a%20b.com/": None, "https://x.com/a//../b": "https://x.com/a/b", "https://x.com/a\t/b": "https://x.com/a/b",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string").withColumn("u", web.canonical_url(F.col("raw")))
    assert {r.raw: r.u for r in df.collect()} == cases | {None: None}
    keys = {
        "https://x.com/a/../b/./c": "https://x.com/b/c", "https://x.com/p?q=(1)'&u=~": "https://x.com/p?q=%281%29%27&u=%7E", "https://x.com/p?u=%7e&q=%281%29%27": "https://x.com/p?q=%281%29%27&u=%7E", "https://x.com/p?q=a+b": "https://x.com/p?q=a+b", "https://x.com/p?q=a%20b": "https://x.com/p?q=a+b",
        "https://x.com/p/?%75tm_source=1&x": "https://x.com/p?x=", "https://x.com/p?b=2&a=2&b=1&&a=1": "https://x.com/p?a=2&a=1&b=2&b=1", "https://x.com/p?q=100%&r=%zz": "https://x.com/p?q=100%25&r=%25zz", "https://x.com/p?a=b=c": "https://x.com/p?a=b%3Dc", "https://x.com/?ref=1#x": "https://x.com/",
        "https://x.com/a//": "https://x.com/a/", "http:example.com": "http://example.com/", "example.com": None, "ftp://x.com/": None, "https://x.com/p?é=1": "https://x.com/p?%C3%A9=1",
    }
    df = spark.createDataFrame([(k,) for k in keys], "raw string").withColumn("u", web.url_dedupe_key(F.col("raw")))
    assert {r.raw: r.u for r in df.collect()} == keys


def test_robots_and_crawl(spark):
    text = "User-agent: bad\nDisallow: /\n\nUser-agent: *\nDisallow: /private # no\nAllow: /private/ok\n"
    rules = web.parse_robots(spark.createDataFrame([("s.org", text)], "site string, text string"))
    assert rules.count() == 2
    urls = spark.createDataFrame([("s.org", p) for p in ("/private/thing", "/private/ok", "/public")], "site string, path string")
    assert {r.path: r.allowed for r in web.robots_allowed(urls, rules).collect()} == {"/private/thing": False, "/private/ok": True, "/public": True}
    link = lambda *h: "".join(f'<a href="{x}">x</a>' for x in h)
    pages = [
        ("https://s.org/", "text/html", link("/a", "/private/thing", "/hidden", "/data.csv", "/pic", "https://other.org/x", "/gone", "/a?utm_source=z")),
        ("https://s.org/a", "text/html", link("/", "/deep")),
        ("https://s.org/hidden", "text/html", '<meta name="robots" content="noindex">' + link("/b")),
        ("https://s.org/data.csv", "text/csv", ""),
        ("https://s.org/pic", "image/png", ""),
        ("https://s.org/b", "text/html", ""),
        ("https://s.org/deep", "text/html", ""),
    ]
    df = spark.createDataFrame(pages, "url string, content_type string, html string")
    starts = spark.createDataFrame([("s.org", "https://s.org/")], "site string, url string")
    got, skipped = web.crawl_pages(df, rules, starts, 1, 25)
    assert [r.name for r in got.orderBy("n").collect()] == ["01-s.html", "02-a.html", "03-data.csv"]
    assert {r.url: r.reason for r in skipped.collect()} == {"https://s.org/private/thing": "robots", "https://s.org/hidden": "noindex", "https://s.org/pic": "unsupported", "https://s.org/gone": "fetch-error"}
    assert web.crawl_pages(df, rules, starts, 2, 25)[0].count() == 5
    assert web.crawl_pages(df, rules, starts, 2, 2)[0].count() == 2


def test_the_crawl_parses_reached_pages_only_and_counts_over_ranges(spark, monkeypatch, tmp_path):
    n, log = 300, str(tmp_path / "parsed")
    read = web._links.func

    def noted(url, html):
        with open(log, "a") as f:
            f.writelines(u + "\n" for u in url)
        return read(url, html)

    def _links(url: pd.Series, html: pd.Series) -> pd.DataFrame:
        return noted(url, html)

    monkeypatch.setattr(web, "_links", F.pandas_udf(_links, web._links.returnType))
    own = [("https://s.org/", "text/html", "".join(f'<a href="/p/{i}">x</a>' for i in range(n)))]
    own += [(f"https://s.org/p/{i}", "text/html", ('<meta name="robots" content="noindex">' if i % 10 == 3 else "") + f'<a href="/q/{i}">x</a>') for i in range(n)]
    own += [(f"https://s.org/q/{i}", "text/html", "") for i in range(n)]
    df = spark.createDataFrame(own, "url string, content_type string, html string").repartition(4)
    starts = spark.createDataFrame([("s.org", "https://s.org/")], "site string, url string")
    rules = spark.createDataFrame([], "site string, allow boolean, path string")
    got, skipped = web.crawl_pages(df, rules, starts, 1, 200)
    want = ["https://s.org/", *(f"https://s.org/p/{i}" for i in range(n) if i % 10 != 3)][:200]
    assert [r.url for r in got.orderBy("n").collect()] == want and sorted(r.n for r in got.collect()) == list(range(1, 201))
    assert skipped.count() == sum(i % 10 == 3 for i in range(int(want[-1].rsplit("/", 1)[1])))
    parsed = open(log).read().split()
    assert len(parsed) == len(set(parsed)) == n + 1 and not any("/q/" in u for u in parsed)


def test_html_and_xml(spark):
    html = "<body><nav>menu</nav><article><h1>T</h1><script>var x='</p>'</script><p>one<p>two <b>three<footer>end</footer></article><p>out</body>"
    df = spark.createDataFrame([(html, "<r><a>x  y</a> <b>z</b></r>"), ("", "<r>")], "html string, xml string")
    got = df.select(web.html_to_text(F.col("html")).alias("t"), files.xml_to_text(F.col("xml")).alias("x")).collect()
    assert got[0].t == "T\none\ntwo three" and got[0].x == "x y z"
    assert got[1].t == "" and got[1].x is None


def test_generation_and_retries(spark):
    docs = spark.createDataFrame([(1, "A long first sentence stands here. " * 40), (2, "x" * 1200)], "doc_id long, text string")
    specs = planning.build_specs(chunking.chunk_documents(docs), 4).withColumn("chunk_index", F.col("index"))

    def fn(messages, settings):
        text = messages[1]["content"].split("EXCERPT:\n")[1]
        if len(text) > 900:
            raise ValueError("maximum context length exceeded")
        return '[{"instruction": "q", "output": "a"}]'

    done = generate.shrink_retry(specs, fn, styles=["factual"])
    pairs, failures = generate.parse_responses(done.drop("temperature", "max_tokens"))
    assert pairs.count() == 2 and failures.count() == 0
    assert generate.complete(planning.build_prompts(specs, ["factual"]), fn).where("error is not null").count() == 2
    both = generate.template_pairs(specs.select("doc_id", "chunk_index", "voice_index", "pairs", "text"), ("factual", "instruction"))
    assert both.where("type = 'instruction'").count() == 2 and both.count() == 8


def test_curation_and_pricing(spark):
    pairs = spark.createDataFrame([(1, "q1", "a", "factual", "up", False, 1), (2, "q2", "b", "instruction", None, False, 1)], "id int, instruction string, output string, type string, rating string, edited boolean, doc_id long")
    out = curate.upsert_pairs(pairs, spark.createDataFrame([(2, "z")], "id int, output string"))
    assert [(r.output, r.edited) for r in out.orderBy("id").collect()] == [("a", False), ("z", True)]
    change = "id int, seq int, fields array<string>, output string, rating string, edited boolean"
    rows = [(1, 1, ["rating"], None, None, None), (2, 2, ["output"], "second", None, None), (2, 1, ["output", "rating"], "first", "down", None), (9, 1, ["output"], "nobody", None, None)]
    out = curate.upsert_pairs(pairs, spark.createDataFrame(rows, change))
    assert [(r.id, r.output, r.rating, r.edited) for r in out.orderBy("id").collect()] == [(1, "a", None, True), (2, "second", "down", True)]
    out = curate.upsert_pairs(pairs, spark.createDataFrame([(1, 1, ["edited", "rating"], None, "down", False), (2, None, None, "z", None, None), (None, 1, ["output"], "x", None, None)], change))
    assert [(r.id, r.output, r.rating, r.edited) for r in out.orderBy("id").collect()] == [(1, "a", "down", False), (2, "z", None, True)]
    assert curate.filter_pairs(pairs, status="unrated").count() == 1 and curate.delete_pairs(pairs, pairs.where("id = 1")).count() == 1
    assert curate.replace_documents(pairs, pairs.where("id = 1")).count() == 1
    new = generate.regenerate_pairs(pairs, pairs.where("id = 1").select("id"), spark.createDataFrame([(1, "some text of the document")], "doc_id long, text string"), lambda m, s: '[{"instruction": "new", "output": "text"}]')
    assert {r.id: (r.instruction, r.rating) for r in new.collect()} == {1: ("new", None), 2: ("q2", None)}
    runs = spark.createDataFrame([("api", "GPT-4o-mini-2024"), ("ollama", "x"), ("api", None)], "provider string, model string")
    assert {(r.provider, r.model): r.price_in for r in pricing.price_lookup(runs).collect()} == {("api", "GPT-4o-mini-2024"): 0.15, ("ollama", "x"): 0.0, ("api", None): None}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"Sentence number {i} is here for you. " * 8) for i in range(5)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream_generate(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert read_pairs(spark, str(tmp_path / "out")).count() == pairs_of(docs).count() == 50


def test_write_dataset(spark, tmp_path):
    pairs = spark.createDataFrame([(i, f'a "{i}", b', None if i % 2 else "o", "factual") for i in range(10)], "id int, instruction string, output string, type string")
    assert export.write_dataset(pairs, str(tmp_path / "d"), "jsonl", "chatml", 0.2) == {"train": 8, "val": 2}
    assert export.write_dataset(pairs, str(tmp_path / "c"), "csv") == {"train": 10}
    assert files.read_delimited(spark, str(tmp_path / "c")).count() >= 10


def test_delimited_files_become_documents(spark, tmp_path):
    (tmp_path / "faq.csv").write_text('question,answer\n"What, exactly?","It is ""this""\nand that"\n\nWhy?, Because ,extra\n,,\n')
    (tmp_path / "plain.csv").write_text("1,apples\n2,\n")
    (tmp_path / "head.csv").write_text("only,a header\nsecond,row\n")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in files.read_records(spark, str(tmp_path)).collect()}
    assert got["faq.csv"] == 'Record 1\nquestion: What, exactly?\nanswer: It is "this"\nand that\n\nRecord 2\nquestion: Why?\nanswer: Because\nColumn 3: extra'
    assert got["plain.csv"] == "Record 1\nColumn 1: 1\nColumn 2: apples\n\nRecord 2\nColumn 1: 2"
    assert got["head.csv"] == "Record 1\nonly: second\na header: row"


def test_delimited_text_is_cut_as_it_is_quoted(spark):
    cases = {
        'a,b\nc\n': [["a", "b"], ["c"]], 'a,"b,""c""\nd",\r\n': [["a", 'b,"c"\nd', ""]], 'x"y,z"w,v': [["xy,zw", "v"]], '"open,\nto the end': [["open,\nto the end"]], '""\n , \n\n"""",1': [['"', "1"]],
        'a,,\n,b': [["a", "", ""], ["", "b"]], "": [], "one": [["one"]], 'a\rb,"c\r"': [["ab", "c\r"]], '"a""': [['a"']], "x" * 100_000 + ',"' + "y\n" * 50_000 + '"': [["x" * 100_000, "y\n" * 50_000]],
    }
    files_ = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(cases)], "path string, value string")
    got = {}
    for r in files.split_delimited(files_).orderBy("path", "ord").collect():
        got.setdefault(r.path, []).append(r.cells)
    assert {f"f{i}": rows for i, rows in enumerate(cases.values()) if rows} == got
    tabs = files.split_delimited(spark.createDataFrame([("t", "a,b\tc|d")], "path string, value string"), "\t").first()
    assert tabs.cells == ["a,b", "c|d"]
    assert files.split_delimited(spark.createDataFrame([("t", "a|b")], "path string, value string"), "|").first().cells == ["a", "b"]


def test_a_deep_chain_of_folders_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = listing.written
    monkeypatch.setattr(listing, "written", lambda df, name: (rounds.append(name), real(df, name))[1])
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"d{i}", None, 0, i < 500) for i in range(501)]
    rows += [("lost", "nowhere", "l", None, 1, False), ("under a file", "n500", "u", None, 1, False), ("r1", "r2", "r", None, 0, True), ("r2", "r1", "r", None, 0, True), ("in ring", "r1", "f", None, 1, False), ("top", None, "t.txt", "text/plain", 7, False)]
    df = spark.createDataFrame(rows, "id string, parent_id string, name string, mime string, size long, is_folder boolean")
    got = {r.id: r.path for r in listing.listing_paths(df).collect()}
    assert got == {"n500": "/".join(f"d{i}" for i in range(501)), "top": "t.txt"}
    assert len(rounds) <= 12


def test_tallies_fill_while_the_rows_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "a.md", 9), (".env", ".env", 9), ("x.pem", "x.pem", 1), ("b.bmp", "b.bmp", 9), ("e.md", "e.md", 0)], "path string, name string, size long")
    kept, out, counts = listing.partition_written(df, str(tmp_path / "l"))
    assert kept.count() == 1 and out.count() == 4 and counts == {"secret": 2, "unsupported": 1, "empty": 1}
    pairs = spark.createDataFrame([("What is it now?", "It is a thing of some length.", "factual"), ("", "x", "instruction")], "instruction string, output string, type string")
    validated, summary = quality.with_summary(quality.validate_pairs(pairs))
    both, stats = curate.with_stats(validated, 0.5)
    both.write.parquet(str(tmp_path / "p"))
    assert tuple(summary.get.values()) == tuple(quality.quality_summary(validated).first()) and tuple(stats.get.values()) == tuple(curate.dataset_stats(pairs, 0.5).first())
    assert both._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


def test_malformed_xml_is_told_apart(spark):
    df = spark.createDataFrame([(1, "<r><a>x  y</a> <b>z</b></r>"), (2, "<r>"), (3, "<r/>"), (4, None), (5, "<r>a & b</r>")], "id int, text string")
    good, bad = files.xml_documents(df)
    assert {r.id: r.text for r in good.collect()} == {1: "x y z"} and {r.id: r.reject_reason for r in bad.collect()} == {2: "malformed", 3: "no text", 4: "malformed", 5: "malformed"}


def test_voices_with_gaps_share_the_pairs(spark):
    chunks = spark.createDataFrame([(1, i, 2, "t") for i in range(2)], "doc_id long, index int, total int, text string")
    voices = spark.createDataFrame([(0, "a", "A is this"), (3, "b", "B is that")], "voice_index int, id string, persona string")
    got = sorted((r["index"], r.voice_index, r.persona_id, r.persona, r.pairs) for r in planning.build_specs(chunks, 6, voices).collect())
    assert got == [(0, 0, "a", "A is this", 2), (0, 1, "b", "B is that", 2), (1, 0, "a", "A is this", 1), (1, 1, "b", "B is that", 1)]


def test_headers(spark):
    rows = [(["name", "age"], 2, True), (["name", "age"], 1, False), (["name", ""], 2, False), (["name", "-3.5"], 2, False), (["name", None], 2, False), (["a1", "3x"], 5, True)]
    df = spark.createDataFrame(rows, "cells array<string>, n int, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", files.is_header(F.col("cells"), F.col("n"))).collect())


def test_text_files_are_documents(spark, tmp_path):
    (tmp_path / "a.md").write_text("\n one\ntwo \u00a0\n")
    (tmp_path / "Makefile").write_text("all:\n\tmake\n")
    got = {r.name: r.text for r in files.read_text_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "one\ntwo", "Makefile": "all:\n\tmake"}
    kinds = {r.name: r.kind for r in listing.assign_kind(files.read_text_documents(spark, str(tmp_path))).collect()}
    assert kinds == {"a.md": "prose", "Makefile": "code"}


def test_document_prompts_cut_and_say_so(spark):
    df = spark.createDataFrame([(1, "x" * 6001, "A nurse", "Nurse"), (2, "y" * 6000, None, None), (3, None, None, None)], "doc_id long, text string, persona string, persona_name string")
    got = {r.doc_id: [m.content for m in r.messages] for r in planning.build_document_prompts(df, 5, ["factual", "instruction"], "basic", "law").collect()}
    assert "x" * 6000 + planning.CUT_NOTE in got[1][1] and "x" * 6001 not in got[1][1]
    assert planning.CUT_NOTE not in got[2][1] and "Generate exactly 5 question-answer pairs" in got[2][1] and 'Domain/context tag: "law".' in got[2][1]
    assert "A nurse" in got[1][0] and "point of view of: Nurse." in got[1][1] and "point of view" not in got[2][1] and "Mix both styles" in got[2][1]


def test_written_lines_are_those_of_the_pairs(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 'say "hi", now', "two\nlines", "factual"), (2, " lead", None, "instruction"), (3, "plain", "", "factual")], "id int, instruction string, output string, type string")
    export.write_dataset(pairs, str(tmp_path / "j"), "jsonl", "chatml")
    want = sorted(r.line for r in export.serialize(pairs, "jsonl", "chatml").collect())
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect()) == want
    export.write_dataset(pairs, str(tmp_path / "c"), "csv")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert '"say ""hi"", now","two\nlines",factual' in lines and " lead,,instruction" in lines and "instruction,output,type" in lines


def test_a_long_chain_of_near_duplicates_is_settled(spark):
    edges = spark.createDataFrame([(i, i + 1, i) for i in range(12)], "i int, j int, ord_i int")
    assert {r.dup_id: r.keep_id for r in dedup.greedy_keep(edges).collect()} == {i: i - 1 for i in range(1, 13, 2)}


def test_groups_keep_the_kind_of_exact_copies(spark):
    rows = ["what is the colour of the sky", "what is the colour of the sky", "what is the colour of the sky?!", "what is the colour of the skyx", "how do plants grow in the dark", "how do plants grow in the darkx"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(rows)], "id int, ord int, instruction string")
    got = {r.dup_id: (r.keep_id, r.match_kind, r.group_kind) for r in dedup.find_duplicates(df, 0.8).collect()}
    assert got == {1: (0, "exact", "exact"), 2: (0, "exact", "exact"), 3: (0, "fuzzy", "exact"), 5: (4, "fuzzy", "fuzzy")}
    assert tuple(dedup.duplicate_counts(dedup.find_duplicates(df, 0.8)).first()) == (2, 2, 2)


def test_chunks_leave_one_python_node_and_one_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "word " * 3000), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    specs = planning.build_specs(chunking.chunk_documents(spark.read.parquet(str(tmp_path / "d"))), 4).withColumnRenamed("index", "chunk_index")
    plan = generate.template_pairs(specs.select("doc_id", "chunk_index", "voice_index", "pairs", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("FileScan parquet") == 1
