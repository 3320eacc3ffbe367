"""Toxicity classifier with a counterfactual penalty.

Words present in a text, and the beginnings of 3, 4 and 5 bytes of its words,
are the features of a logistic regression with an elastic-net penalty; the words
it selects are then fitted again with a tenth of the penalty, which shrinks less. In labelled sentences that mention an identity term, the
term is swapped for each other term of its group and for none, and the squared
change of the score (in log-odds) is penalised, so that mentioning a group does
not by itself move the score.

Labels are learnt from a bounded sample of the labelled rows: about ``max_rows``,
by a hash of id and text, rows equal in both once. Training sees at most ``max_rows`` lists of words in one task;
the model is the list of words with a weight. Every row is scored, whole.

Defined cases: null and empty texts get the score of no words. Rows labelled
more than once count once with the highest label; null labels are ignored; with
no labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import drawn, held_out, table

#: Terms of one group are swapped for each other; groups are of one language each (English, German, French, Spanish).
IDENTITY = (
    ("women", "men"),
    ("woman", "man"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("immigrant", "citizen", "refugee"),
    ("immigrants", "citizens", "refugees"),
    ("old", "young"),
    ("disabled", "blind", "deaf"),
    ("frauen", "männer"),
    ("schwule", "lesben", "heteros", "bisexuelle"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("ausländer", "einheimische", "flüchtlinge", "einwanderer"),
    ("femmes", "hommes"),
    ("gays", "lesbiennes", "hétéros", "bisexuels"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("immigrés", "citoyens", "réfugiés"),
    ("mujeres", "hombres"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("inmigrantes", "ciudadanos", "refugiados"),
)
THRESHOLD = 0.7
MAX_ROWS = 8_000
_SENTENCE = np.zeros(256, bool)
_SENTENCE[list(b".!?\n")] = True


#: Lengths in bytes of the beginnings of words that are features too.
BEGINNINGS = (3, 4, 5)


def _present(batch: pa.RecordBatch, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all words (one row for words, one for each length of beginnings; 0: none), begin bytes and row offsets of the words, lower-cased bytes."""
    data, offsets = K.flat(batch.column("text"))
    data = K.LOWER[data]
    starts, ends, cut = K.spans(data, offsets, K.ALNUM)
    h = np.zeros((1 + len(BEGINNINGS), len(starts)), np.uint64)
    if len(starts):
        h[0] = K.word_hash(data, starts, ends)
        for i, n in enumerate(BEGINNINGS):
            long = np.flatnonzero(ends - starts > n)
            h[i + 1, long] = K.range_hash(data, starts[long], starts[long] + n) ^ np.uint64(n)
        h[1:, np.isin(h[0], terms)] = 0  # a swapped term leaves nothing behind
    return h, starts, cut, data


def _features(terms: np.ndarray):
    """For training: distinct word hashes of each row, and how many of its sentences mention each identity term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                h, starts, cut, data = _present(batch, terms)
                sentence = np.cumsum(_SENTENCE[data]) if len(data) else np.empty(0, np.int64)
                words, mentions = [], []
                for i in range(batch.num_rows):
                    own = h[:, cut[i] : cut[i + 1]]
                    words.append(np.unique(own[own != 0]).view(np.int64))
                    hit = np.flatnonzero(np.isin(own[0], terms)) + cut[i]
                    pairs = {(int(t), int(s)) for t, s in zip(h[0, hit].view(np.int64), sentence[starts[hit]], strict=True)}
                    mentions.append([t for t, _ in sorted(pairs)])
                yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(mentions, pa.list_(pa.int64()))], names=["toxic", "words", "mentions"])

    return run


def fit(rows: list[tuple[int, np.ndarray, list[int]]], groups: Sequence[Sequence[int]], swap_penalty: float, l1: float, l2: float, rounds: int, max_features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, weights, bias) by accelerated proximal gradient steps; max_features: words kept, the most telling one by one."""
    y = np.array([r[0] for r in rows], float)
    flat, size = np.concatenate([r[1] for r in rows]), np.array([len(r[1]) for r in rows])
    words, index, df = np.unique(flat, return_inverse=True, return_counts=True)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both labels count alike
    doc = np.repeat(np.arange(len(rows)), size)
    mass = np.bincount(index, weights=weight[doc], minlength=len(words))
    gap = np.abs(np.bincount(index, weights=(weight * (2 * y - 1))[doc], minlength=len(words))) / np.sqrt(mass * (1 - np.minimum(mass, 1 - 1e-9)))
    named = np.isin(words, np.array([g for group in groups for g in group], np.int64))
    telling = np.lexsort((words, -np.where(df >= 2, gap, 0.0) - np.where(named, 1e9, 0.0)))[:max_features]
    common = np.zeros(len(words), bool)
    common[telling] = (df >= 2)[telling] | named[telling]
    own = common[index]
    doc, index = doc[own], (np.cumsum(common) - 1)[index[own]]
    words = words[common]
    n_words = len(words)
    at = {int(w): i for i, w in enumerate(words)}
    swaps: dict[tuple[int, int], float] = {}
    n_mentions = max(1, sum(len(r[2]) for r in rows))
    for _, _, mentions in rows:
        for term in mentions:
            for group in groups:
                if term in group:
                    for other in (*(g for g in group if g != term), 0):  # 0: no term at all
                        key = at.get(term, -1), at.get(other, -1)
                        swaps[key] = swaps.get(key, 0.0) + 1 / (n_mentions * len(group))
    pairs = np.array([k for k in swaps if k[0] != k[1]], np.int64).reshape(-1, 2)
    cost = np.array([swaps[tuple(p)] for p in pairs])

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(doc, weights=w[index], minlength=len(y)) + b
        r = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(index, weights=r[doc], minlength=n_words) + l2 * w
        if len(pairs):
            full = np.append(w, 0.0)  # a term that is no feature weighs nothing
            change = 2 * swap_penalty * cost * (full[pairs[:, 0]] - full[pairs[:, 1]])
            extra = np.zeros(n_words + 1)
            np.add.at(extra, pairs[:, 0], change)
            np.add.at(extra, pairs[:, 1], -change)
            g += extra[:-1]
        return g, r.sum()

    # a step of its own for each word: the sums of the rows of a bound of the Hessian bound it from above
    per = np.bincount(doc, minlength=len(y)) + 1.0
    step = 1 / (0.25 * np.bincount(index, weights=(weight * per)[doc], minlength=n_words) + l2 + 1e-9)
    if len(pairs):
        bound = np.zeros(n_words + 1)
        np.add.at(bound, pairs.ravel(), np.repeat(4 * swap_penalty * cost, 2))
        step = 1 / (1 / step + bound[:-1])
    bias_step = 1 / (0.25 * (weight * per).sum())
    def descend(w: np.ndarray, b: float, l1: float, free: np.ndarray) -> tuple[np.ndarray, float]:
        yw, yb, t = w, b, 1.0
        for _ in range(rounds):
            g, gb = gradient(yw, yb)
            new = yw - step * g
            new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0) * free
            nb = yb - bias_step * gb
            if (g * (new - w)).sum() + gb * (nb - b) > 0:  # restart the momentum when it leads uphill
                t = 1.0
            t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
            yw, yb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
            w, b, t = new, nb, t2
        return w, b

    w, b = descend(np.zeros(n_words), 0.0, l1, np.ones(n_words))
    chosen = w != 0
    if chosen.any():  # the features left are few: keep only their entries
        own = chosen[index]
        doc, index = doc[own], index[own]
        w, b = descend(w, b, l1 / 10, chosen)
    keep = w != 0
    order = np.argsort(words[keep].view(np.uint64))
    return words[keep].view(np.uint64)[order], w[keep][order], b


def _trained(groups: Sequence[Sequence[int]], *options):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            words = batch.column("words")
            for y, own, m in zip(batch.column("toxic").to_pylist(), words, batch.column("mentions").to_pylist(), strict=True):
                rows.append((y, own.values.to_numpy(), m))
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))  # the same sums whatever order rows come in
        if len({r[0] for r in rows}) < 2:
            words, w, b = np.empty(0, np.uint64), np.empty(0), -np.inf
        else:
            words, w, b = fit(rows, groups, *options)
        yield pa.RecordBatch.from_arrays([pa.array([words.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([float(b)])], names=["words", "weights", "bias"])
        rows.clear()
        K.release()

    return run


def train(
    labelled: DataFrame,
    max_rows: int = MAX_ROWS,
    identity: Sequence[Sequence[str]] = IDENTITY,
    swap_penalty: float = 1.0,
    l1: float = 5e-4,
    l2: float = 1e-6,
    rounds: int = 600,
    max_features: int = 4096,
) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """A model (features, weights, bias, identity terms) from labelled (doc_id, text, toxic); of more than ``max_rows`` rows, a sample by hash of id and text."""
    own = labelled.where("toxic is not null").withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    n = own.count()
    sample = drawn(own, "h", F.lit(max_rows / max(1, n))).dropDuplicates(["doc_id", "h"])
    groups = [[int(np.uint64(K.hash_word(t.encode())).view(np.int64)) for t in g] for g in identity]
    terms = np.array(sorted({t for g in groups for t in g}), np.int64).view(np.uint64)
    features = sample.select("text", "toxic").mapInArrow(_features(terms), "toxic int, words array<long>, mentions array<long>")
    words, weights, bias = features.repartition(1).mapInArrow(_trained(groups, swap_penalty, l1, l2, rounds, max_features), "words binary, weights binary, bias double").first() if n else (b"", b"", -np.inf)
    words, weights = np.frombuffer(words, np.uint64), np.frombuffer(weights)
    return words, weights, bias, terms


Model = tuple[np.ndarray, np.ndarray, float, np.ndarray]


def _scores(model: Model, columns: list[str], text: str):
    words, weights, bias, terms = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, text):
                h, _, cut, _ = _present(batch.select([text]).rename_columns(["text"]), terms)
                z = np.full(batch.num_rows, bias)
                if h.size and len(words):
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    hit = np.nonzero(words[at] == h)
                    seen = np.unique((np.searchsorted(cut, hit[1], "right") - 1) * len(words) + at[hit])
                    z += np.bincount(seen // len(words), weights=weights[seen % len(words)], minlength=batch.num_rows)
                score = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(bias) else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], names=[*columns, "score"])
        K.release()

    return run


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, tag, score), a row for each document; tag is a hash of its text."""
    given = docs.select(id_column, F.xxhash64("text").alias("tag"), "text")
    return given.mapInArrow(_scores(model, [id_column, "tag"], "text"), f"{id_column} {dict(given.dtypes)[id_column]}, tag long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, where: Column | None = None) -> DataFrame:
    """(doc_id, text, toxic) of the documents with a label."""
    one = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = one if where is None else one.where(where)
    return docs.select("doc_id", "text").join(own, "doc_id")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``docs``, without rows whose score reaches the threshold."""
    model = train(labelled_rows(docs, labels, ~held_out(F.col("doc_id"))))
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    kept = renamed.mapInArrow(_scores(model, renamed.columns, f"c{columns.index('text')}"), ", ".join(f"c{i} {kind}" for i, (_, kind) in enumerate(docs.dtypes)) + ", score double")
    return kept.where(F.col("score") < threshold).drop("score").toDF(*columns)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(labelled_rows(docs, labels, ~held_out(F.col("doc_id"))))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
