"""Overlapping chunks at natural boundaries.

The break search looks at the last fifth of a chunk; where a chunk ends decides
where the next begins, so the walk along one text is a small vectorised helper.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE, OVERLAP = 4000, 300
#: Documents whose chunks form one batch.
ROWS_AT_ONCE = 256
_SENTENCE = (". ", "! ", "? ", ".\n", "!\n", "?\n")


def _after(text: str, mark: str, low: int, high: int) -> int:
    """End of the last ``mark`` that begins in [low, high], or -1."""
    at = text.rfind(mark, low, high + len(mark))
    return -1 if at < 0 else at + len(mark)


def _break(text: str, low: int, high: int, code: bool) -> int:
    cut = _after(text, "\n\n", low, high)
    if code:
        at = high
        while cut < 0 and (at := text.rfind("\n", low, min(at, len(text) - 1) + 1)) >= 0:
            if at + 1 < len(text) and text[at + 1] not in " \t":
                cut = at + 1
            at -= 1
        marks: tuple[str, ...] = ("\n",)
    else:
        marks = (*_SENTENCE, " ")
    for mark in marks:
        if cut >= 0:
            break
        cut = _after(text, mark, low, high)
    return high if cut < 0 else cut


def spans(text: str, size: int, overlap: int, code: bool) -> list[tuple[int, int]]:
    out, start = [], 0
    while start + size < len(text):
        cut = _break(text, start + size * 4 // 5, start + size, code)
        out.append((start, cut))
        start = max(start + 1, cut - overlap)
    return [*out, (start, len(text))]


def chunk_documents(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """The columns of ``docs`` without text, with index, total, start, end and chunk text; kind 'code' cuts at lines.

    Texts are cut where they are read, and each chunk leaves as a row of its own:
    no row ever holds all chunks of a document.
    """
    keys = [c for c in docs.columns if c not in ("text", "kind")]
    kind = F.col("kind") if "kind" in docs.columns else F.lit("prose")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                row, total, index, start, end, text = [], [], [], [], [], []
                for r, (t, k) in enumerate(zip(part.column("text").to_pylist(), part.column("kind").to_pylist(), strict=True)):
                    t = t or ""
                    own = spans(t, size, overlap, k == "code")
                    row += [r] * len(own)
                    total += [len(own)] * len(own)
                    index += range(len(own))
                    start += [a for a, _ in own]
                    end += [b for _, b in own]
                    text += [t[a:b] for a, b in own]
                which = pa.array(row, pa.int64())
                numbers = (pa.array(x, pa.int32()) for x in (total, index, start, end))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(which) for c in keys), *numbers, pa.array(text, pa.string())], names=[*keys, "total", "index", "start", "end", "text"])

    schema = T.StructType([*(docs.schema[c] for c in keys), *(T.StructField(c, T.IntegerType()) for c in ("total", "index", "start", "end")), T.StructField("text", T.StringType())])
    return docs.select(*keys, "text", kind.alias("kind")).mapInArrow(cut, schema)


def estimate_chunks(n_chars: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return F.when(F.coalesce(n_chars, F.lit(0)) <= size, F.lit(1)).otherwise(F.ceil((n_chars - overlap) / (size - overlap))).cast("long")
