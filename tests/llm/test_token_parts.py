"""Rows that share an id are encoded by more than one task."""

from pairforge.llm import tokens


def test_rows_of_one_id_are_dealt_to_all_parts(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else 5, f"text number {i}") for i in range(400)], "doc_id long, text string")
    tokens.write_tokens(docs, str(tmp_path / "t"), tokens.default_tokenizer())
    files = spark.read.parquet(str(tmp_path / "t"))
    parts = {r.part: len(r.doc_ids) for r in files.select("part", "doc_ids").collect()}
    assert sum(parts.values()) == 400 and len(parts) == 4 and max(parts.values()) < 150
    rows = sorted(tokens.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [5] * 200 + [None] * 200
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))


def test_pieces_of_any_length_give_the_ids_of_whole_texts():
    import random

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(5)
    own, plain = tokens.PieceTokenizer(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    words = ["".join(rng.choice("abcé,.\n ") for _ in range(n)) for n in (*range(1, 40), 7, 8, 9, 15, 16, 17, 22, 23, 24, 25) for _ in range(20)]
    for _ in range(3):
        rng.shuffle(words)
        texts = [" ".join(words[i : i + 9]) for i in range(0, len(words), 9)] + ["", None, "x" * 50]
        ids, n = own.encode(pa.array(texts))
        want = [[*plain.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
        assert n.tolist() == [len(w) for w in want]
        assert np.array_equal(ids, np.concatenate(want))


def test_coder_takes_large_vocabularies_and_long_blocks():
    import numpy as np

    from pairforge.llm import coder

    rng = np.random.default_rng(3)
    for ids, size in ((rng.integers(0, 300_000, 40_000), 300_000), (np.zeros(200_000, int), 50_257), (np.tile(rng.integers(0, 9, 700), 300), 10), (rng.integers(0, 2, 70_000), 2)):
        assert np.array_equal(coder.decode(coder.encode(ids.astype(np.uint32), size)), ids)
