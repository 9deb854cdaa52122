"""Entities from a tagger of the caller's (D2): model or dictionary, run per
batch inside the Spark tasks.

A tagger is a function from a list of texts to a list of entity lists, each entity
``(start, end, label)`` in code points, end exclusive.  ``make`` builds it, once
per Python task, so that a model is loaded where it is used.  Texts of one call
hold about ``BATCH_CHARS`` characters together; one longer text is a call alone.

Null texts are not tagged.  An entity whose offsets are null, not whole numbers,
negative, reversed, empty or beyond the end of its text, or whose label is null, is
an error under ``invalid="raise"`` and left out under ``invalid="drop"``.  Entities
that a tagger gives twice stay twice."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from numbers import Integral

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

BATCH_CHARS = 1_000_000
Tagger = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def fault(start, end, label, length: int) -> str | None:
    """Why an entity cannot stand in a text of ``length`` code points."""
    if not all(isinstance(x, Integral) and not isinstance(x, bool) for x in (start, end)):
        return "offsets are not whole numbers"
    if start < 0 or end > length:
        return "offsets lie outside the text"
    if start >= end:
        return "the span is empty or reversed"
    return None if isinstance(label, str) else "the label is not a string"


def batches_of(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with at most ``limit`` characters, or one text."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > limit:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def tag_entities(df: DataFrame, make: Callable[[], Tagger], key_cols: list[str], text_col: str, invalid: str = "raise",
                 batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Entities ``keys, s, e, label`` of every text, as ``mask`` takes them in
    ``entities``.  Only keys and text go to Python, and only keys come back."""
    if invalid not in ("raise", "drop"):
        raise ValueError("invalid must be 'raise' or 'drop'")
    if {"s", "e", "label", "_text"} & set(key_cols):
        raise ValueError("key columns must not be called s, e, label or _text")
    schema = StructType([*(df.schema[c] for c in key_cols), StructField("s", IntegerType()), StructField("e", IntegerType()), StructField("label", StringType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = make()
        for part in parts:
            keys, texts = part.columns[:-1], part.column(part.num_columns - 1).to_pylist()
            for a, b in batches_of(texts, batch_chars):
                answer = tagger(texts[a:b])
                if len(answer) != b - a:
                    raise ValueError(f"the tagger answered {len(answer)} lists for {b - a} texts")
                at, found = [], []
                for i, (text, entities) in enumerate(zip(texts[a:b], answer), a):
                    for s, e, label in entities:
                        if reason := fault(s, e, label, len(text)):
                            if invalid == "raise":
                                raise ValueError(f"entity {(s, e, label)} in a text of {len(text)} characters: {reason}")
                            continue
                        at.append(i)
                        found.append((int(s), int(e), label))
                s, e, label = zip(*found) if found else ((), (), ())
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([*(k.take(rows) for k in keys), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(label, pa.string())],
                                                 names=schema.names)

    return df.where(F.col(text_col).isNotNull()).select(*key_cols, F.col(text_col).alias("_text")).mapInArrow(run, schema)
