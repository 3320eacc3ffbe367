"""What goes to a Python worker at once is small, and no text goes twice."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pairforge.llm import kernel as K
from pairforge.llm import tokens, toxicity


def test_texts_are_encoded_in_slices(monkeypatch):
    met = []

    def encode(self, texts):
        met.append(texts.nbytes)
        return np.zeros(len(texts), np.uint32), np.ones(len(texts), np.int64)

    monkeypatch.setattr(tokens.PieceTokenizer, "encode", encode)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "text": ["ab " * 50_000] * 60, "part": pa.array([0] * 60, pa.int32())})
    out = list(tokens._encoded(tokens.default_tokenizer(), tokens.BLOCK_IDS)(iter([batch])))
    assert sum(sum(b.column("n_ids").to_pylist()) for b in out) == 60
    assert len(met) > 4 and max(met) <= K.SLICE_BYTES + 4_096


def test_a_worker_remembers_a_bounded_number_of_pieces():
    tokenizer = tokens.PieceTokenizer(tokens.default_tokenizer())
    for at in range(0, 600_000, 100_000):
        tokenizer.encode(pa.array([" ".join(f"{i:x}q" for i in range(at, at + 100_000))]))
    assert len(tokenizer.known) < 450_000


def test_toxicity_sends_each_text_once(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    out = toxicity.accepted(docs, labels)
    assert out.columns == docs.columns and {r.doc_id % 2 for r in out.collect()} == {0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.split("MapInArrow")[1].splitlines()[1].split(", ")) == 2


def test_stages_get_small_batches_and_the_session_keeps_its_own(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, met = spark.conf.get(name), []

    def stage(spark, docs, sf_dir):
        met.append(int(spark.conf.get(name)))
        return docs.limit(3)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 3
    assert met == [corpus_pipeline.BATCH_ROWS] * 2 and spark.conf.get(name) == before
