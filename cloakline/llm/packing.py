"""Best-fit packing of documents into fixed-length sequences (sum of squares).

A document becomes token ids plus an end id.  Documents over ``size`` ids are
cut so that every piece but the first is full; full pieces fill a sequence of
their own.  The others are placed by the sum-of-squares rule: with N(g) open
sequences of gap g, a piece goes where the sum of N(g)^2 over all gaps becomes
smallest.  That rule is sequential, so it runs per block: pieces are dealt
round-robin (no key, so no skew) into blocks of about ``block_rows`` pieces,
each placed in one task; a block wastes at most a few open sequences.  Within
a block longer pieces go first, ties by id and text position.

Null text counts as empty (its one id is the end id); repeated rows and null
ids are packed like any other; an empty table gives no rows; columns other than
the id, the text and ``carry`` are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm import tokens
from cloakline.llm.common import python_ready, written

BLOCK_ROWS = 131_072
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"


def token_pieces(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its number, where it starts among the document's ids,
    its length and its ids (little-endian unsigned 32-bit)."""
    python_ready(docs.sparkSession)
    path = tokenizer or tokens.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        end = np.uint32(end_id).tobytes()
        for keys, texts in tokens.groups(batches):
            out: list[list] = [[], [], [], [], []]
            for doc, data in zip(keys.to_pylist(), enc.encode(texts)):
                data += end
                n = len(data) // 4
                at, piece = 0, 0
                while at < n:
                    take = (n - 1) % size + 1 if piece == 0 else size
                    for col, v in zip(out, (doc, piece, at, take, data[4 * at:4 * (at + take)])):
                        col.append(v)
                    at, piece = at + take, piece + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Place pieces in the given order: (sequence, offset) of each, and the
    number of sequences.  Lengths are 1 to ``size``."""
    count = np.zeros(size + 1, dtype=np.int64)  # N(g); only 0 < g < size is ever filled
    open_at: list[list[int]] = [[] for _ in range(size + 1)]
    seq = np.empty(len(lengths), dtype=np.int64)
    off = np.empty(len(lengths), dtype=np.int64)
    used = 0
    huge = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        if s == size:
            seq[i], off[i], used = used, 0, used + 1
            continue
        # change of the sum when gap g becomes r = g - s, halved: N(r) - N(g) + 1
        left, gap = count[:size - s + 1], count[s:]
        cost = np.where(gap > 0, 2 * (left - gap) + 2, huge)
        if gap[0] > 0:
            cost[0] = 1 - 2 * gap[0]  # filled up: gap 0 is no open sequence
        cost[-1] = 2 * left[-1] + 1  # a new sequence
        r = int(cost.argmin())
        g = r + s
        if g == size:
            where, used = used, used + 1
        else:
            where = open_at[g].pop()
            count[g] -= 1
        seq[i], off[i] = where, size - g
        if r:
            open_at[r].append(where)
            count[r] += 1
    return seq, off, used


def place(pieces: DataFrame, size: int = 1024, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece, start and length;
    other columns are carried along."""
    blocks = max(1, -(-pieces.count() // block_rows))
    spark_schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        length = t.column("length").to_numpy()
        doc = t.column("doc_id").fill_null(-1).to_numpy()
        order = np.lexsort((t.column("piece").to_numpy(), doc, -length))
        seq = np.empty(len(order), dtype=np.int64)
        off = np.empty(len(order), dtype=np.int64)
        seq[order], off[order], _ = sum_of_squares(length[order], size)
        seq += TaskContext.get().partitionId() << 40
        yield from t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).to_batches(10_000)

    return pieces.repartition(blocks).mapInArrow(pack, spark_schema)


def pack(docs: DataFrame, size: int = 1024, end_id: int = 2, tokenizer: str | None = None,
         carry: list[Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces with their place.  ``carry``: what to keep of a piece besides
    doc_id, piece, start and length (default: its ids); keeping only a digest
    keeps the ids out of the shuffle."""
    pieces = token_pieces(docs, size, end_id, tokenizer, id_col, text_col)
    kept = written(pieces.select("doc_id", "piece", "start", "length", *(carry if carry is not None else [F.col("ids")])), "pieces")
    full = kept.where(F.col("length") == size)  # a sequence of their own, wherever they lie
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))
    return place(kept.where(F.col("length") < size), size, block_rows).unionByName(full)
