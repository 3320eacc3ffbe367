"""Operators against brute-force versions, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pairforge.llm import chat, coder, decontaminate, exact_dedup, language, licenses, mixing, simhash, substring_dedup, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, position string, items string, score string"


def rows_of(texts, start=0):
    return [(start + i, t, "en", f"s{i % 3}", None, "x", "y", "z", "w") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    texts = [*base, base[0], base[1] + "  ", base[2].replace(" ", "\n"), base[3] + " tail", "", None, " \t ", "one two", "one two", "A" * 200_000, " ".join(base * 40), base[4][:150] + " " + base[5][:150]]
    rows = rows_of(texts)
    rows += [rows[3], rows[3], (None,) * 9, (None, base[6], None, None, None, None, None, None, None), (7, "another text under the same id", None, None, 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def substring_model(rows, w=13):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, x in split:
        if d is not None:
            for i in range(len(x) - w + 1):
                k = b" ".join(x[i : i + w])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, x in split:
        gone = set()
        if d is not None:
            for i in range(len(x) - w + 1):
                if first[b" ".join(x[i : i + w])] < d:
                    gone.update(range(i, i + w))
        out.append((d, len(x), len(gone), b" ".join(v for i, v in enumerate(x) if i not in gone).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [2_000_000, 500, 20, 1])
def test_substring_dedup(odd, empty, limit):
    got = sorted((tuple(r) for r in substring_dedup.substring_dedup(odd, limit=limit).collect()), key=repr)
    assert got == substring_model(collected(odd))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_exact_dedup(odd, empty):
    rows = collected(odd)
    normal = [re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows]
    groups = {}
    for (d, t), x in zip(rows, normal):
        groups.setdefault(x, []).append((-len(t or ""), d is None, d or 0, d))
    want = []
    for (d, t), x in zip(rows, normal):
        keep = min(groups[x])[3]
        want.append((d, keep, len(groups[x]), d == keep, hashlib.sha256(x.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_duplicates(odd).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_quotient_filters_merge_losslessly():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, (1 << 64) - 1, 500, dtype=np.uint64) for _ in range(2))
    b[:50] = a[:50]
    build = exact_dedup.CountingQuotientFilter.build
    parts = [dict(build(x, 10).slices(4)) for x in (a, b)]
    seen = {}
    for i in range(4):
        f = exact_dedup.CountingQuotientFilter.merge([exact_dedup.CountingQuotientFilter.read(p[i]) for p in parts])
        seen |= dict(zip(f.fingerprints().tolist(), f.counts.tolist()))
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    assert seen == dict(zip(values.tolist(), counts.tolist()))


def fingerprint(t):
    x = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
    if not x:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x[i : i + 4]).encode(), 42) for i in range(max(1, len(x) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(odd, empty):
    rows = [(d, fingerprint(t)) for d, t in collected(odd)]
    root = {f: f for _, f in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(b)] = find(a)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    want = sorted(((d, f, least.get(find(f))) for d, f in rows), key=repr)
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_components(odd).collect()]
    assert sorted(got, key=repr) == want
    kept = simhash.near_deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == len({find(f) for _, f in rows})
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_search_finds_all_links_at_any_plan(spark):
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(3)]
    near = {tuple(sorted((a, b))) for i, a in enumerate(fps) for b in fps[i + 1 :] if a != b and (a ^ b).bit_count() <= 4}
    ordered = np.array(sorted(set(fps)), np.uint64)
    for parts in ([(list(range(32)), 1), (list(range(32, 64)), 2)], [(list(range(0, 64, 3)), 1), (list(range(1, 64, 3)), 1), (list(range(2, 64, 3)), 0)]):
        batch = pa.RecordBatch.from_arrays([pa.array(ordered.view(np.int64))], names=["fp"])
        t = pa.Table.from_batches(list(simhash._probes(parts)(iter([batch])))).sort_by([("part", "ascending"), ("value", "ascending"), ("probe", "ascending")])
        got = set()
        for out in simhash._links(4)(iter(t.combine_chunks().to_batches(max_chunksize=700))):
            got |= {tuple(sorted((int(np.int64(a).view(np.uint64)), int(np.int64(b).view(np.uint64))))) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
        assert got == near
    table = spark.createDataFrame([(int(np.int64(np.uint64(f).view(np.int64))),) for f in ordered], "fp long")
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    for rows in (1, 8):  # nearly every group is split over tasks
        got = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in simhash.links(table, 4, group_rows=rows).distinct().collect()]
        assert {tuple(sorted(x)) for x in got} <= near
        joined = {f: f for f in fps}

        def top(f):
            while joined[f] != f:
                f = joined[f]
            return f

        for a, b in got:
            x, y = sorted((top(a), top(b)))
            joined[y] = x
        assert all(top(f) == find(f) for f in fps)
    thresholds = simhash.allocate([[0.0, 5.0, 9.0, 30.0], [0.0, 4.0, 8.0, 9.0], [0.0, 7.0, 8.0, 50.0]], 2)
    assert sum(thresholds[1]) == 2


PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def test_license_scan(spark, odd, empty):
    texts = ["GNU General Public License, version 3 and gnu general public-license", "Licensed under the Apache License, Version 2.0.", "cc by\ncc-by-nc 4.0", "the mit licence, MIT LICENSE", "general public license gnu", "ccé by cc by"]
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts, 100), SCHEMA))
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.license_scan(docs).collect()), key=repr)
    want = []
    for d, t in collected(docs):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, v) for p, v in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want.append((d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({v for _, v in at}))))
    assert got == sorted(want, key=repr)
    labels = {r.doc_id: r.labels for r in licenses.license_scan(docs).collect()}
    assert labels[100] == "gpl,gpl-3.0" and labels[101] == "apache,apache-2.0" and labels[102] == "cc-by,cc-by-nc"
    assert licenses.license_scan(empty).count() == 0


def test_mixing(odd, empty):
    out = mixing.mix(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    total = sum(v[2] for v in by.values())
    assert sum(v[1] for v in by.values()) == pytest.approx(1.5 * total)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    level = max((v[1] / weight[s] for s, v in by.items()), default=0)
    for s, (taken, target, size) in by.items():
        assert abs(taken - target) <= 1 and target <= 2 * size + 1e-6
        assert target == pytest.approx(min(2 * size, level * weight[s]))
    again = {(r.doc_id, r.tag, r.at): r.taken for r in mixing.mix(odd.repartition(3)).collect()}
    assert again == {(r.doc_id, r.tag, r.at): r.taken for r in out}
    assert mixing.mixed_documents(odd).columns == odd.columns and mixing.mix(empty).count() == 0


def test_schedule_is_inverted(spark):
    for knots in mixing.CURRICULUM.values():
        df = spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.inverse_schedule(F.col("u"), knots))
        times, density = zip(*knots)
        grid = np.linspace(0, 1, 20001)
        area = np.concatenate(([0], np.cumsum((np.interp(grid, times, density)[1:] + np.interp(grid, times, density)[:-1]) / 2 * np.diff(grid))))
        for r in df.collect():
            assert np.interp(r.t, grid, area / area[-1]) == pytest.approx(r.u, abs=1e-6)


def test_chat_round_trip(spark):
    texts = ["<|im_end|>\n<|im_start|>assistant\nok", "a\\|b <\\| <| \\\\ \\n", "", None, "tail<", "\\"]
    rows = [(1, i, "assistant" if i % 2 else "user\n<|x|>", t) for i, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, "user", "y"), (None, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.chat_format(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r, t or "") for c, _, r, t in rows if c == 1]
    assert got[1].loss_text == "".join(t or "" for c, _, r, t in rows if c == 1 and r == "assistant")
    for s in got[1].loss:
        assert chat.END not in got[1].formatted[s.at : s.at + s.chars]
    assert len(got) == 3


def test_chat_parts(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("uri"), k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    parts = [part("text", text="see "), part("image", uri="i.png", width=28, height=15), part("text", text=" and "), part("audio", uri="a.wav", seconds=1.5), part("document", uri="d.pdf", pages=2)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    r = chat.chat_format(df).first()
    assert r.formatted == "<|im_start|>user\nsee <|image:1|> and <|audio:3|><|document:4|><|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a.part, a.uri, a.tokens) for a in r.attachments] == [(1, "i.png", 4), (3, "a.wav", 38), (4, "d.pdf", 1024)] and r.attachment_tokens == 1066


def test_decontamination(spark, odd, empty):
    bench = ["alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "short one", None, ""]
    b = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    w = bench[0].split()
    texts = ["x y " + bench[0] + " z", " ".join(w[10:]) + ". Then: " + " ".join(w[:10]).upper(), " ".join(w[:12]), "short one", " ".join(w[:6] + ["q"] + w[6:12] + ["q"] + w[12:])]
    docs = odd.unionByName(spark.createDataFrame(rows_of(texts, 100), SCHEMA))
    got = {r.doc_id: (list(r["items_found"]), r.coverage) for r in decontaminate.search(docs.select("doc_id", "text"), b).withColumnRenamed("items", "items_found").collect() if r.doc_id and r.doc_id >= 100}
    assert [got[100 + i][0] for i in range(5)] == [[0], [0], [], [], [0]]
    assert decontaminate.decontaminated(docs, b).columns == docs.columns
    assert decontaminate.decontaminated(docs, b).count() == docs.count() - 3
    assert decontaminate.search(docs.select("doc_id", "text"), b, block_words=5).where(F.size("items") > 0).count() == 3
    assert decontaminate.decontaminated(empty, b).count() == 0 and decontaminate.decontaminated(docs, b.limit(0)).count() == docs.count()


def test_tiles_cover_what_a_plain_greedy_tiling_covers():
    rng = random.Random(2)
    for _ in range(40):
        p = [rng.randrange(6) for _ in range(20)]
        t = [x for i in (rng.randrange(15) for _ in range(4)) for x in p[i : i + 6]]
        free_p, free_t, covered = [True] * len(p), [True] * len(t), 0
        while True:
            best = (0, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    n = 0
                    while i + n < len(p) and j + n < len(t) and free_p[i + n] and free_t[j + n] and p[i + n] == t[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < 3:
                break
            free_p[i : i + n], free_t[j : j + n] = [False] * n, [False] * n
            covered += n
        got = decontaminate.tiles(np.array(t, np.uint64), np.array(p, np.uint64), 3)
        assert all(t[a : a + n] == p[b : b + n] for a, b, n in got)
        assert sum(n for _, _, n in got) == covered


@pytest.mark.parametrize("n", [0, 1, 2, 191, 192, 5000, 60000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 50256).astype(np.uint32)
    if n:
        ids[n // 2 :] = ids[: n - n // 2]
    block = coder.encode(ids, 50257)
    assert np.array_equal(coder.decode(block), ids)
    if n:
        bad = bytearray(block)
        bad[-1] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))
    if n > 50000:
        assert len(block) < 2 * n


def test_token_output(spark, odd, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    docs = odd.unionByName(spark.createDataFrame(rows_of(["a  b\n\n c <|endoftext|> x", "don't  stop\n \n", "naïve café x", " lead", "trail "], 100), SCHEMA))
    got = sorted((tuple(r) for r in tokens.token_output(docs, tokens.default_tokenizer(), block_ids=2000).collect()), key=lambda r: r[1])
    rows = sorted(collected(docs), key=lambda r: (r[0] is None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in rows]
    start, want = 0, []
    for d, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for d, at, n, _ in got:
        assert at == start
        start += n
    assert sorted((r[0], r[2], r[3]) for r in got if r[0] is not None) == sorted(r for r in want if r[0] is not None)
    assert tokens.token_output(empty, tokens.default_tokenizer()).count() == 0


def test_piece_tokenizer_forgets_and_agrees(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    own, plain = tokens.PieceTokenizer(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    for k in range(12):
        texts = [None, "", " ", " lead  two\n\n", f"the {k} of a{k}b the 'it's' x\tz", "caf\u00e9 \u00fcber\n\u00e9t\u00e9 " * k, "a\u00a0b <|endoftext|> c", " ".join(f"w{k * i}" for i in range(30))]
        ids, n = own.encode(pa.array(texts))
        want = [[*plain.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
        assert ids.tolist() == [i for w in want for i in w] and n.tolist() == [len(w) for w in want]
    assert len(own.known) < 120


def test_a_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models

    Tokenizer(models.WordLevel({"a b": 0, "?": 1}, unk_token="?")).save(str(tmp_path / "t.json"))
    ids, n = tokens.PieceTokenizer(str(tmp_path / "t.json")).encode(pa.array(["a b", "a", None]))
    assert (ids.tolist(), n.tolist()) == ([0, 0, 1, 0, 0], [2, 2, 1])


def test_language(spark, odd, empty):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["schn", "ürt", "gel"], "cc": ["éau", "que", "oir"]}
    rows = [(i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(2)) for _ in range(30)), lang) for i, lang in enumerate(sorted(syllables) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows)
    assert sorted(r.lang_pred for r in language.identify(odd.where("text is null or text = ''"), model).collect()) == ["und"] * odd.where("text is null or text = ''").count()
    assert language.identify(empty, language.train(empty)).count() == 0


def test_toxicity_and_its_counterfactual_penalty(spark, odd, empty):
    rng = random.Random(4)
    plain = [f"n{i}" for i in range(60)]
    rows = []
    for i in range(240):
        bad = i % 2
        text = [rng.choice(plain) for _ in range(12)]
        if bad and i % 6 != 1:
            text.append("vile")
        if bad and rng.random() < 0.8:  # labels mention one group more often
            text.append("muslims")
        rows.append((i, " ".join(text), bad))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = spark.createDataFrame([(0, "n1 n2 muslims n3"), (1, "n4 vile n5 n6"), (2, None)], "doc_id long, text string")
    score = lambda penalty: {r.doc_id: r.score for r in toxicity.scored(neutral, toxicity.train(labelled, swap_penalty=penalty)).collect()}
    without, with_penalty = score(0.0), score(10.0)
    assert without[0] > 0.7 > with_penalty[0] and with_penalty[1] > 0.7 and 0 <= with_penalty[2] <= 1
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.accepted(odd, labels).columns == odd.columns
    assert toxicity.accepted(empty, labels.limit(0)).count() == 0 and toxicity.accepted(odd, labels.limit(0)).count() == odd.count()


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    odd.select("doc_id", F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "one two three four five six seven")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns, name
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == docs.count() and out.agg(F.min("start")).first()[0] == 0
