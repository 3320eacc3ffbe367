"""The labels of the licence scan against a plain version of the method, and whole licence texts."""

import math
import random
import re

from pairforge.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def model(texts, templates, rare=4, share=0.5):
    """(base labels, labels, base places) of each text, word for word."""
    docs = [words(t) for t in texts]
    vocabulary = {w for t in templates for w in t.text.split()}
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in map(set, docs)))) for w in vocabulary}
    out = []
    for d in docs:
        has, looked = set(d), set()
        for t in templates:
            if not t.base and all(w in has for k in t.keys for w in k.split()):
                looked |= set(sorted((w for w in set(t.text.split()) if w in has), key=lambda w: (-idf[w], w))[:rare])
        base, found, places = set(), set(), 0
        for t in templates:
            own = t.text.split()
            if t.base:
                at = [i for i in range(len(d) - len(own) + 1) if d[i : i + len(own)] == own]
                places += len(at)
                base |= {t.label} if at else set()
                continue
            most = sum(w in looked for w in own)
            starts = {p - q for p, w in enumerate(d) if w in looked for q, x in enumerate(own) if x == w}
            for s in starts:
                votes = sum(0 <= s + q < len(d) and d[s + q] == x for q, x in enumerate(own) if x in looked)
                at = [next(i for i in range(len(own)) if own[i : i + len(k.split())] == k.split()) for k in t.keys]
                held = all(s + q >= 0 and d[s + q : s + q + len(k.split())] == k.split() for q, k in zip(at, t.keys, strict=True))
                if votes >= max(1, math.ceil(share * most)) and held:
                    found.add(t.label)
        out.append((",".join(sorted(base)), ",".join(sorted(base | found)), places))
    return out


def scanned(spark, texts):
    got = L.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return got, [(r.base_labels, r.labels, r.n_base) for r in got]


def test_labels_are_those_of_the_plain_version(spark):
    rng = random.Random(3)
    bodies = [t.text for t in L.NOTICES + L.BODIES]
    vocabulary = sorted({w for b in bodies for w in b.split()})
    texts = [None, "", "MIT License", "cc by", *bodies]
    for _ in range(120):
        own = rng.choice(bodies).split()
        for _ in range(rng.randrange(6)):  # words change, go or come
            k = rng.randrange(len(own))
            own[k : k + rng.randrange(2)] = rng.choices(vocabulary, k=rng.randrange(3))
            own = own or ["x"]
        cut = rng.randrange(len(own))
        texts.append(" ".join(rng.choices(vocabulary, k=rng.randrange(20)) + own[cut // 3 :] + rng.choices(vocabulary, k=5)))
    assert scanned(spark, texts)[1] == model(texts, L.BASE + L.NOTICES + L.BODIES)


def test_whole_licence_texts_are_found_however_they_are_set(spark):
    texts, labels = [], []
    for t in L.BODIES:
        own = t.text.upper().split()
        texts.append("Copyright (c) 2031 Somebody.\n\n * " + "\n * ".join(" ".join(own[i : i + 9]) for i in range(0, len(own), 9)) + "\nint main() {}")
        labels.append(t.label)
        texts.append(" ".join(own[: len(own) // 3]) + " " + " ".join(f"other{i}" for i in range(40)))
        labels.append(None)
    got, _ = scanned(spark, texts)
    for r, label in zip(got, labels, strict=True):
        if label:
            assert label in r.labels.split(",") and r.score > 0.99


def test_the_query_is_the_plain_version_over_all_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r.doc_id: (r.base_labels, r.labels, r.n_base) for r in L.op6_license_scan(spark, d).collect()}
    assert got == dict(zip(docs, model(docs.values(), L.BASE + L.NOTICES + L.BODIES), strict=True))
