"""Token-id files: Parquet list columns, sorted by document id.

Texts are encoded where they lie; the ids are range-partitioned and sorted by
document id and written as Parquet with an ``ids`` list column (dictionary-encoded pages falling back to delta
encoding of format version 2), bounded row groups and small pages with page
indexes, so that a reader can fetch the ids of a few documents or the metadata
columns alone.  File order is id order, and a file has about ``FILE_BYTES`` of
text.  Each row holds how many ids its file has before it; ``read_token_files``
adds the totals of the files before, summed over one row a file (that table is
the only one broadcast).

Null text counts as empty.  Repeated ids are ordered by a hash of the token ids,
then by these; repeated rows stay repeated.  Null ids come first.  Other columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakline.llm import tokens
from cloakline.llm.common import python_ready, written
from cloakline.session import ensure_checkpoint_dir

#: bytes of a row group and of a page in a token file
ROW_GROUP_BYTES = 32 * 1024 * 1024
PAGE_BYTES = 64 * 1024
FILE_BYTES = 64 * 1024 * 1024
SCHEMA = "file int, first bigint, doc_id bigint, n_tokens bigint, ids array<int>"


def encoded(docs: DataFrame, end_id: int = 0, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``width`` and ``data``: the ids of each text and ``end_id``, as
    little-endian unsigned integers of ``width`` bytes (2 if all ids of the
    vocabulary fit, which halves what is shuffled)."""
    python_ready(docs.sparkSession)
    file = tokenizer or tokens.default_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(file)
        width = 2 if max(enc.tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.uint32(end_id).tobytes()
        for keys, texts in tokens.groups(batches):
            ids, at = enc.encode_array(texts, end)
            data = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
            widths = pa.array(np.full(len(keys), width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([keys, widths, data], names=["doc_id", "width", "data"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id bigint, width int, data binary")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one file, in order, with their ids as lists."""
    from pyspark import TaskContext

    tokens.forget()  # all is encoded: the memory is for the lists
    part, first = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, width = batch.column(2).to_pylist(), batch.column(1)[0].as_py()  # one tokenizer, one width
        n = np.fromiter((len(x) // width for x in raw), dtype=np.int64, count=len(raw))
        for a, b in _groups(n):
            ends = np.concatenate(([0], np.cumsum(n[a:b]))).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(raw[a:b]), dtype=f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(b - a, part, dtype=np.int32)), pa.array(ends[:-1] + np.int64(first)), batch.column(0).slice(a, b - a),
                pa.array(n[a:b]), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["file", "first", "doc_id", "n_tokens", "ids"])
            first += int(ends[-1])


def _groups(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Index ranges of rows with about a million ids."""
    start = total = 0
    for i, x in enumerate(n.tolist()):
        total += x
        if total >= 1 << 20:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(n):
        yield start, len(n)


def write_token_files(docs: DataFrame, path: str, end_id: int = 0, tokenizer: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode every text, append ``end_id``, write the files under ``path``."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    rows = encoded(docs, end_id, tokenizer, id_col, text_col).withColumn("h", F.xxhash64("data"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("h").asc(), F.col("data").asc()]
    # encoded once: the range bounds come from a sample of the written ids, not from encoding twice
    kept = written(rows, "token-rows")
    ordered = kept.repartitionByRange(max(1, -(-size // file_bytes)), by[0], by[1]).sortWithinPartitions(*by).select("doc_id", "width", "data")
    (ordered.mapInArrow(_listed, SCHEMA).write
     .option("compression", "zstd")
     .option("parquet.writer.version", "v2")  # delta encoding where the dictionary gives up
     .option("parquet.enable.dictionary", "true")
     .option("parquet.block.size", str(ROW_GROUP_BYTES))
     .option("parquet.page.size", str(PAGE_BYTES))
     .parquet(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files with ``start``: the ids of all documents before."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("t"))
    before = totals.select("file", (F.sum("t").over(Window.orderBy("file")) - F.col("t")).alias("base"))  # a row a file
    return rows.join(F.broadcast(before), "file").select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids")


def token_table(docs: DataFrame, **options) -> DataFrame:
    """Write the files of ``docs`` to the shared folder and read them back."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, **options)
    return read_token_files(spark, path)
