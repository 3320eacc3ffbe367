"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters of a text, lower-cased, with every run of anything else as one gap, give
n-grams of 1 to 3 characters, hashed into 2**``BITS`` cells. A cell's value is
log(1 + count) times its inverse document frequency; a document's values have
norm 1. Weights are trained by follow the regularised leader (proximal) with an
elastic net, and a temperature is then fitted on rows kept aside.

Document frequencies are counted over all training rows. The weights are fitted
on a bounded sample: about ``max_rows`` training rows by hash of id and text,
shared evenly over the languages, rows equal in both once; one task trains on their sparse vectors.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as
is everything when nothing can be learnt. A row is returned for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import drawn, held_out, table

BITS = 13
CELLS = 1 << BITS
MAX_ROWS = 4_000
MAX_LANGS = 1_000
_GAP = 0
#: Rows of one dense block.
_BLOCK = 256


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    points = np.arange(0x110000, dtype=np.uint32)
    out = np.zeros(0x110000, bool)
    keep = (points < 0xD800) | (points > 0xDFFF)
    out[keep] = np.char.isalpha(points[keep].view("U1"))
    return out


_table: list[np.ndarray] = []


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Dense counts of n-gram cells for each text, and whether it has a letter."""
    if not _table:
        _table.append(_letters())
    lower = [(t or "").lower() for t in texts]
    size = np.array([len(t) + 2 for t in lower])
    points = np.frombuffer("".join(f"\n{t}\n" for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _table[0][points]
    doc = np.repeat(np.arange(len(texts)), size)
    some = np.bincount(doc[letter], minlength=len(texts)) > 0
    points = np.where(letter, points, _GAP)
    edge = np.zeros(len(points), bool)
    edge[np.cumsum(size) - size] = True
    keep = letter | edge | np.append(False, letter[:-1])  # one gap after each run of letters
    points, doc = points[keep].astype(np.uint64), doc[keep]
    cells = np.zeros(len(texts) * CELLS, np.int32)
    h = np.zeros(len(points), np.uint64)
    for n in range(1, 4):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = K.mix(h[:m] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n))
        at = doc[:m] * CELLS + (h >> np.uint64(64 - BITS)).astype(np.int64)
        inside = doc[:m] == doc[n - 1 :]
        cells += np.bincount(at[inside], minlength=len(cells)).astype(np.int32)
    return cells.reshape(len(texts), CELLS), some


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in K.slices(whole, "text"):
            for i in range(0, part.num_rows, _BLOCK):
                yield part.slice(i, _BLOCK)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, rows = np.zeros(CELLS, np.int64), 0
    for batch in _blocks(batches):
        cells, some = _counts(batch.column("text").to_pylist())
        total += (cells > 0).sum(axis=0)
        rows += int(some.sum())
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, CELLS)), pa.array(np.append(rows, total))], names=["cell", "n"])


def _values(cells: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(cells, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            cells, some = _counts(batch.column("text").to_pylist())
            x = _values(cells, idf)
            own = [np.flatnonzero(r).astype(np.int32) for r in x]
            out = pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), pa.array(own, pa.list_(pa.int32())), pa.array([r[k] for r, k in zip(x, own, strict=True)], pa.list_(pa.float32()))], names=["h", "lang", "cell", "value"])
            yield out.filter(pa.array(some))

    return run


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias): FTRL-proximal on rows (class, cells, values)."""
    z, n = np.zeros((CELLS + 1, classes)), np.zeros((CELLS + 1, classes))
    weigh = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for y, cells, values in rows:
            at, x = np.append(cells, CELLS), np.append(values, 1.0)
            w = weigh(z[at], n[at])
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weigh(z, n)
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""

    def loss(t: float) -> float:
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for h, lang, c, v in zip(batch.column("h").to_pylist(), batch.column("lang").to_pylist(), batch.column("cell"), batch.column("value"), strict=True):
            rows.append((h, lang, c.values.to_numpy(), v.values.to_numpy()))
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
    langs = sorted({r[1] for r in rows})
    y = [(langs.index(r[1]), r[2], r[3]) for r in rows]
    held = y[::5] if len(y) >= 50 else y
    fit = [r for i, r in enumerate(y) if i % 5] if len(y) >= 50 else y
    w, b = ftrl(fit, len(langs)) if y else (np.zeros((CELLS, 0)), np.zeros(0))
    t = temperature(np.array([r[2] @ w[r[1]] + b for r in held]), np.array([r[0] for r in held])) if len(langs) > 1 else 1.0
    yield pa.RecordBatch.from_arrays([pa.array([langs], pa.list_(pa.string())), pa.array([(w / t).astype(np.float32).tobytes()], pa.binary()), pa.array([(b / t).tobytes()], pa.binary())], names=["langs", "weights", "bias"])


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.idf, self.weights, self.bias = langs, idf, weights, bias


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from rows (doc_id, text, lang); null languages count for the document frequencies only."""
    counted = dict(rows.select("text").mapInArrow(_frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    idf = np.array([np.log((1 + counted.get(-1, 0)) / (1 + counted.get(i, 0))) + 1 for i in range(CELLS)], np.float32)
    known = rows.where("lang is not null")
    # at most MAX_LANGS counts come to the driver; the languages beyond share one rate, as if they were one language of several shares
    per = known.groupBy("lang").count()
    n_langs, n_rows = per.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    common = per.orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    share, others = max_rows / max(1, n_langs), n_rows - sum(r["count"] for r in common)
    rate = F.create_map(*(F.lit(x) for r in common for x in (r["lang"], share / r["count"]))) if common else F.create_map(F.lit(""), F.lit(1.0))
    rest = share * (n_langs - len(common)) / max(1, others)
    hashed = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    sample = drawn(hashed, "h", F.coalesce(F.try_element_at(rate, F.col("lang")), F.lit(rest))).dropDuplicates(["doc_id", "h", "lang"])
    vectors = sample.select("h", "lang", "text").mapInArrow(_vectors(idf), "h long, lang string, cell array<int>, value array<float>")
    found = vectors.repartition(1).mapInArrow(_trained, "langs array<string>, weights binary, bias binary").first()
    langs = list(found["langs"]) if found else []
    weights = np.frombuffer(found["weights"], np.float32).reshape(CELLS, len(langs)) if langs else np.zeros((CELLS, 0), np.float32)
    return Model(langs, idf, weights, np.frombuffer(found["bias"]) if langs else np.zeros(0))


def _predicted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            cells, some = _counts(batch.column("text").to_pylist())
            if model.langs:
                z = _values(cells, model.idf) @ model.weights + model.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                lang = [model.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]
                score = np.where(some, p[np.arange(len(p)), best], 0.0)
            else:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score.astype(float))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score), a row for each document."""
    return docs.select("doc_id", "text").mapInArrow(_predicted(model), "doc_id long, lang_pred string, score double")


def op2_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
