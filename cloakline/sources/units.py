"""Unit shapers (S4-S9): tables <-> text units, and their write-back.

The reference walks document containers; here every container kind is a table
shape, and the masking core only sees ``(scope, unit, text)`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, splitlines

# Unit kinds this library shapes (the reference's file kinds, re-aimed).
KINDS = ("text", "lines", "fragments", "cells", "nodes")


def check_kind(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"unsupported unit kind {kind!r}; supported: {', '.join(KINDS)}")
    return kind


# ── S9: page lines ───────────────────────────────────────────────────────────

def line_units(df: DataFrame, file_cols: list[str], page_col: str | None, text_col: str) -> DataFrame:
    """One row per line (``str.splitlines``) of each page; null page -> no lines.
    Columns: file cols, ``page_no``, ``line_no`` (0-based), ``text``."""
    page = F.col(page_col) if page_col else F.lit(1)
    return (df.select(*file_cols, page.alias("page_no"),
                      F.posexplode_outer(splitlines(F.col(text_col))).alias("line_no", "text"))
            .where(F.col("line_no").isNotNull()))


def page_text(lines: DataFrame, pages: DataFrame, file_cols: list[str]) -> DataFrame:
    """Assemble ``--- Page i ---`` + lines joined by newline; pages joined by a
    blank line.  ``pages`` lists every page (``file cols, page_no``) so an empty
    page still gets its heading.  Groups are bounded by one file's pages."""
    per_page = (lines.groupBy(*file_cols, "page_no")
                .agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("ls")))
    per_page = pages.select(*file_cols, "page_no").join(per_page, [*file_cols, "page_no"], "left")
    block = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"),
                     F.array_join(F.transform(F.coalesce(F.col("ls"), F.array().cast(
                         "array<struct<line_no:int,text:string>>")), lambda x: x["text"]), "\n"))
    return (per_page.select(*file_cols, F.struct("page_no", block.alias("b")).alias("pb"))
            .groupBy(*file_cols)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("pb")), lambda x: x["b"]), "\n\n")
                 .alias("text")))


# ── S5: fragmented paragraphs ────────────────────────────────────────────────

def paragraph_units(runs: DataFrame, para_cols: list[str], run_col: str, text_col: str) -> DataFrame:
    """Concatenate the runs of each paragraph in run order (empty text for a
    null run)."""
    return (runs.groupBy(*para_cols)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(run_col).alias("r"),
                                                      F.coalesce(F.col(text_col), F.lit("")).alias("t"))))
                 .alias("_runs"))
            .select(*para_cols, F.array_join(F.transform("_runs", lambda x: x["t"]), "").alias("text"),
                    F.col("_runs")[0]["r"].alias("_first_run")))


def paragraph_write_back(runs: DataFrame, before: DataFrame, after: DataFrame, para_cols: list[str],
                         run_col: str, text_col: str) -> DataFrame:
    """Only if the paragraph changed: first run gets the new text, other runs
    become empty; unchanged paragraphs keep every run as it was."""
    b = before.select(*para_cols, F.col("text").alias("_old"), "_first_run")
    a = after.select(*para_cols, F.col("text").alias("_new"))
    j = runs.join(b, para_cols, "left").join(a, para_cols, "left")
    changed = ~F.col("_old").eqNullSafe(F.col("_new"))
    new_text = (F.when(~changed, F.col(text_col))
                .when(F.col(run_col) == F.col("_first_run"), F.col("_new"))
                .otherwise(F.lit("")))
    return j.withColumn(text_col, new_text).drop("_old", "_new", "_first_run")


# ── S8: cells ────────────────────────────────────────────────────────────────

def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def cell_units(df: DataFrame, row_col: str, include_header: bool = False) -> DataFrame:
    """Every string cell as a unit ``row, col_idx, col, text`` (other types are
    never touched).  With ``include_header`` the header row is unit row 0, so
    header cells take part in numbering like the reference's sheet row 1."""
    cols = [c for c in df.columns if c != row_col]
    strs = [c for c in string_columns(df) if c != row_col]
    idx = {c: i for i, c in enumerate(cols)}
    stacked = df.select(F.col(row_col).alias("row"), F.explode(F.array(*[
        F.struct(F.lit(idx[c]).alias("col_idx"), F.lit(c).alias("col"), F.col(c).alias("text")) for c in strs
    ])).alias("c")).select("row", "c.col_idx", "c.col", "c.text")
    if include_header:
        spark = df.sparkSession
        header = spark.createDataFrame([(None, idx[c], c, c) for c in cols],
                                       f"row {df.schema[row_col].dataType.simpleString()}, col_idx int, col string, text string")
        stacked = header.unionByName(stacked)
    return stacked


# ── S7: text nodes between markup ────────────────────────────────────────────

# What stands between text nodes: comments, script and style elements with all
# they hold, and tags, in which a quoted attribute may hold ">".  What is left open
# runs to the end; a "<" that opens nothing is text.
TAG = (r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*+>|\z)"
       r"""|<[a-z/!?][^'"<>]*+(?:"[^"]*+"[^'"<>]*+|'[^']*+'[^'"<>]*+)*+>""")


def node_units(df: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """Every text node of a marked-up document as a unit ``keys, node_no, text``,
    in document order; blank nodes are no units."""
    return (df.select(*key_cols, F.posexplode_outer(F.split(F.col(text_col), TAG, -1)).alias("node_no", "text"))
            .where(~is_blank(F.col("text"))))


def node_write_back(df: DataFrame, before: DataFrame, after: DataFrame, key_cols: list[str], text_col: str) -> DataFrame:
    """Changed nodes put back between the tags; documents without a changed node
    stay as they are, and their text is not shuffled with the nodes."""
    changed = (before.join(after.select(*key_cols, "node_no", F.col("text").alias("_new")), [*key_cols, "node_no"])
               .where(~F.col("text").eqNullSafe(F.col("_new")))
               .groupBy(*key_cols).agg(F.map_from_entries(F.collect_list(F.struct("node_no", "_new"))).alias("_changed")))  # nodes of one document
    nodes, tags = F.split(F.col(text_col), TAG, -1), F.regexp_extract_all(F.col(text_col), F.lit(TAG), F.lit(0))
    kept = F.transform(nodes, lambda x, i: F.coalesce(F.element_at("_changed", i), x))
    whole = F.array_join(F.flatten(F.zip_with(kept, tags, lambda x, t: F.array(x, F.coalesce(t, F.lit(""))))), "")
    return (df.join(changed, key_cols, "left").withColumn(text_col, F.when(F.col("_changed").isNotNull(), whole).otherwise(F.col(text_col)))
            .select(*df.columns))


# ── S6: order of units inside nested containers ──────────────────────────────

KIND_RANK = {"paragraph": 0, "cell": 1}


def container_order(part: Column, container: Column, kind: Column, row: Column, cell: Column, para: Column) -> Column:
    """Sort key of a unit: inside a container all its paragraphs come before its
    table cells, these row by row, cell by cell, paragraph by paragraph; parts
    (body, then header and footer of each section) in their own order.  Use it
    as ``order_col`` of ``mask``."""
    rank = F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in KIND_RANK.items()])
    none = lambda c: F.coalesce(c.cast("bigint"), F.lit(-1).cast("bigint"))
    return F.struct(none(part).alias("part"), none(container).alias("container"), rank.alias("kind"),
                    none(row).alias("row"), none(cell).alias("cell"), none(para).alias("para"))
