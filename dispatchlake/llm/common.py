"""What the text operators share: words, the shared scratch folder and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dispatchlake.scratch import folder, remove

#: A word is a run of characters other than space and U+0009 to U+000D; bytes.split() cuts alike.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back, so later jobs don't depend on its lineage."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote, once nothing reads them any more."""
    for t in tables:
        for place in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, place)


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text of an Arrow column; empty for null."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def batches_of(batch: pa.RecordBatch, text: int, budget: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) slices of a batch whose texts have about `budget` bytes together."""
    texts = byte_values(batch.column(text))
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > budget:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


class WordIds:
    """Numbers words through a function, keeping the latest answers up to a bound."""

    def __init__(self, number, bound: int = 400_000) -> None:
        self.number, self.bound, self.known = number, bound, {}

    def __call__(self, words: list[bytes], dtype=np.uint64) -> np.ndarray:
        known, number = self.known, self.number
        if len(known) > self.bound:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=dtype)
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = number(w)
            return np.array([known[w] for w in words], dtype=dtype)
