"""Removal of repeated lines across documents.

Units are lines (or paragraphs) of at least ``min_words`` words.  A unit's
digest is that of its normalised form: lower case, every run of ASCII characters
other than letters and digits one blank, trimmed.  Digests are grouped globally
(partial aggregates, so a line that a third of all documents share is counted
before it is shuffled); the earliest occurrence by id, row and unit number
stays, every other is a removed span with its original offsets (code points,
end exclusive, the line end not included).

``repeated_passages`` (and ``cleaned``) also take lines of fewer words that stand
in ``min_docs`` rows, texts of scripts without blanks by their characters, and
runs of sentences inside lines that differ elsewhere.

A unit that stands more than once in a text is counted there, so a text sends one
row a distinct unit to the global grouping, whose buffers are plain numbers; the
join back takes digests that occur often in salted parts.

Null and empty texts have no units.  Lines repeated inside one document count as
repeats too.  Repeated rows are occurrences in the order they are read.  Rows
with a null id come last and so never keep a line from a row with an id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import packed, python_ready, written
from cloakline.operators.registry import hot_keys, salted_join
from cloakline.operators.splice import splice

MIN_WORDS = 10
#: documents in which a line of fewer words must stand
MIN_DOCS = 3
LONG, SHORT, RUN = 0, 1, 2
DIGEST = ["h1", "h2", "kind"]
UNITS = "doc_id bigint, file bigint, row bigint, unit int, start bigint, end bigint, kind int, h1 bigint, h2 bigint, n bigint, again boolean"
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SENTENCE = re.compile("[.!?\u2026]+[\"')\\]\u201d\u2019]*\\s+|[\u3002\uff01\uff1f]+[\u300d\u300f\u201d\u2019]*\\s*")
_JUNK = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def normalise(unit: str) -> str:
    return _JUNK.sub(" ", unit.lower()).strip(" ")


def units_of(text: str, sep: str, min_words: int) -> Iterator[tuple[int, int, int, int, str]]:
    """Lines of at least ``min_words`` words: number, start, end, kind, form."""
    at = 0
    for k, unit in enumerate(text.split(sep)):
        if unit.count(" ") + 1 >= min_words or len(unit) >= 2 * min_words:
            norm = normalise(unit)
            if norm.count(" ") + 1 >= min_words:
                yield k, at, at + len(unit), LONG, norm
        at += len(unit) + len(sep)


def _unspaced(norm: str) -> int:
    """Characters of scripts that set no blanks."""
    return 0 if norm.isascii() else len(_UNSPACED.findall(norm))


def passages_of(text: str, sep: str, min_words: int) -> Iterator[tuple[int, int, int, int, str]]:
    """Every non-blank line, and from each sentence of a long line on the shortest
    run of sentences that is long: at least ``min_words`` words, or twice as many
    characters of scripts that set no blanks."""
    at, min_chars = 0, 2 * min_words
    for k, line in enumerate(text.split(sep)):
        ends = [0, *(m.end() for m in _SENTENCE.finditer(line)), len(line)]
        parts = [(a, b, norm) for a, b in zip(ends, ends[1:]) if (norm := normalise(line[a:b]))]
        # the ends of ASCII sentences are blanks in the form, so that the forms of the parts make up the line's
        form = (" ".join(p[2] for p in parts) if line.isascii() else normalise(line)) or line.strip()
        if form:
            if form.count(" ") + 1 >= min_words or _unspaced(form) >= min_chars:
                yield k, at, at + len(line), LONG, form
                words, chars = [p[2].count(" ") + 1 for p in parts], [_unspaced(p[2]) for p in parts]
                upto = w = c = 0
                for i, (a, _, _) in enumerate(parts):
                    while upto < len(parts) and w < min_words and c < min_chars:
                        w, c, upto = w + words[upto], c + chars[upto], upto + 1
                    if w < min_words and c < min_chars:
                        break
                    yield k, at + a, at + parts[upto - 1][1], RUN, " ".join(p[2] for p in parts[i:upto])
                    w, c = w - words[i], c - chars[i]
            else:
                yield k, at, at + len(line), SHORT, form
        at += len(line) + len(sep)


def units(docs: DataFrame, min_words: int = MIN_WORDS, sep: str = "\n", id_col: str = "doc_id", text_col: str = "text",
          row_cols: tuple[str, str] | None = None, split: Callable[[str, str, int], Iterator[tuple[int, int, int, int, str]]] = units_of) -> DataFrame:
    """Written table of the units (``UNITS``): ``file`` and ``row`` tell the rows
    of ``docs`` apart (taken from ``row_cols`` if given), ``h1`` and ``h2`` are the
    digest of kind and form, ``n`` how often a unit stands in its text and
    ``again`` that it is not the first there."""
    python_ready(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes: list[int] = []
            found: list[tuple[int, int, int, int]] = []
            digests: list[bytes] = []
            times: list[int] = []
            again: list[bool] = []
            for text in b.column(3).to_pylist():
                first: dict[str, int] = {}
                before = len(found)
                for k, start, end, kind, form in split(text or "", sep, min_words):
                    key = f"{kind}{form}"
                    at = first.setdefault(key, len(found))
                    again.append(at < len(found))
                    digests.append(digests[at] if again[-1] else blake2b(key.encode(), digest_size=16).digest())
                    times.append(1)
                    if again[-1]:
                        times[at] += 1
                    found.append((k, start, end, kind))
                sizes.append(len(found) - before)
            rows = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            k, start, end, kind = np.array(found, dtype=np.int64).reshape(-1, 4).T
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i).take(rows) for i in range(3)), pa.array(k.astype(np.int32)), pa.array(start), pa.array(end), pa.array(kind.astype(np.int32)),
                 pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(times, pa.int64()), pa.array(again, pa.bool_())],
                names=["doc_id", "file", "row", "unit", "start", "end", "kind", "h1", "h2", "n", "again"])

    file, row = (F.col(c).cast("bigint") for c in row_cols) if row_cols else (F.lit(0).cast("bigint"), F.monotonically_increasing_id())
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), file.alias("file"), row.alias("row"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(cut, UNITS), "units")


def repeats(found: DataFrame, min_docs: int = MIN_DOCS, inside: bool = True) -> DataFrame:
    """Spans to remove: doc_id, file, row, unit, start, end, the document that
    keeps the unit, how often it occurs, and ``whole``: lines, not runs of
    sentences.  Short lines must stand in ``min_docs`` rows.  Runs overlap; the
    earliest copy of a sentence is in no span, as an earlier copy of what holds it
    would hold it too.  Without ``inside``, long units that stand again in their
    own text (gone in any case) come without keeper and number, unjoined."""
    short = F.col("kind") == SHORT
    first = written(found.where("NOT again").groupBy(*DIGEST).agg(F.count("*").alias("docs"), F.sum("n").alias("occurrences"), F.min("doc_id").alias("first_doc_id"))
                    .where((F.col("occurrences") > 1) & (~short | (F.col("docs") >= min_docs))), "repeated")
    out = ["doc_id", "file", "row", "unit", "start", "end", "first_doc_id", "occurrences", (F.col("kind") != RUN).alias("whole")]
    hot = hot_keys(first, DIGEST, "occurrences")
    asked = found if inside else found.where(~F.col("again") | short)
    placed = salted_join(asked.drop("n"), first.drop("docs"), DIGEST, hot, ["file", "row"])
    at_first = ~F.col("again") & F.col("doc_id").eqNullSafe(F.col("first_doc_id"))
    ids = found.select("doc_id", "file", "row").distinct().groupBy("doc_id").count().where("count > 1")
    spans = placed.where(~at_first).select(*out)
    if not ids.isEmpty():  # rows that share an id: the first read keeps
        tied = written(placed.where(at_first), "tied")
        keeper = tied.groupBy(*DIGEST).agg(F.count("*").alias("c"), F.min(F.struct("file", "row")).alias("k")).where("c > 1")
        late = salted_join(tied, keeper, DIGEST, hot, ["file", "row"]).where(F.struct("file", "row") != F.col("k"))
        spans = spans.unionByName(late.select(*out))
    if not inside:
        spans = spans.unionByName(found.where(F.col("again") & ~short).select(
            *out[:6], F.lit(None).cast("bigint").alias("first_doc_id"), F.lit(None).cast("bigint").alias("occurrences"), out[8]))
    return spans


def removed_lines(docs: DataFrame, **options) -> DataFrame:
    return repeats(units(docs, **options)).drop("file", "row", "whole")


def removed_passages(docs: DataFrame, min_docs: int = MIN_DOCS, **options) -> DataFrame:
    """Spans of ``repeats``, without runs inside lines that go whole."""
    spans = written(repeats(units(docs, split=passages_of, **options), min_docs), "passages")
    whole = spans.where("whole")
    return whole.unionByName(spans.where("NOT whole").join(whole.select("file", "row", "unit"), ["file", "row", "unit"], "left_anti")).drop("file", "row")


def cleaned(docs: DataFrame, sep: str = "\n", id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS,
            row_cols: tuple[str, str] | None = None, **options) -> DataFrame:
    """Every row of ``docs`` with repeated passages cut out of its text, and the
    kept parts' original offsets in ``kept_spans`` (array of start, end).

    ``row_cols`` are two number columns that tell rows apart in the same way at
    every reading (file and row in it); without them a copy with row numbers is written."""
    whole = packed(docs)
    if row_cols:
        whole = whole.select("_all", *[F.col(f"_all.{c}").cast("bigint").alias(n) for c, n in zip(row_cols, ("file", "row"))])
    else:
        whole = written(whole.withColumn("file", F.lit(0).cast("bigint")).withColumn("row", F.monotonically_increasing_id()), "line-docs")
    plain = whole.select(F.col(f"_all.{id_col}").alias("doc_id"), F.col(f"_all.{text_col}").alias("text"), "file", "row")
    spans = repeats(units(plain, sep=sep, row_cols=("file", "row"), split=passages_of, **options), min_docs, inside=False)
    upto = F.col("end") + F.when(F.col("whole"), len(sep)).otherwise(0)  # a line goes with its end; spans overlap
    in_text = Window.partitionBy("file", "row").orderBy("start", "end")
    spans = (spans.select("file", "row", "start", "end", F.max(upto).over(in_text.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
             .withColumn("fresh", (F.col("start") > F.lag("upto", 1, -1).over(in_text)).cast("int"))
             .withColumn("part", F.sum("fresh").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
             .groupBy("file", "row", "part").agg(F.min("start").alias("start"), F.max("upto").alias("upto"))
             .groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("start", "upto"))).alias("_cut")))  # parts of one text
    text = F.col(f"_all.{text_col}")
    n = F.length(F.coalesce(text, F.lit(""))).cast("bigint")
    cut = F.coalesce("_cut", F.array().cast("array<struct<start:bigint,upto:bigint>>"))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(cut, lambda s: F.least(s["upto"], n)))
    ends = F.concat(F.transform(cut, lambda s: s["start"]), F.array(n))
    kept = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda s: s["end"] > s["start"])
    gone = F.transform("_cut", lambda s: F.struct(s["start"].cast("int").alias("s"), F.least(s["upto"], n).cast("int").alias("e"), F.lit("").alias("pseudonym")))
    out = whole.join(spans, ["file", "row"], "left").select("_all", kept.alias("_kept"), gone.alias("_gone"))
    return out.select(F.col("_all").withField(text_col, splice(text, F.col("_gone"))).alias("_all"), "_kept").select("_all.*", F.col("_kept").alias("kept_spans"))
