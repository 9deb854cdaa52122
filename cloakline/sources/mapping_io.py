"""Mapping documents and path derivation.

The registry itself is a table (write it as parquet); the JSON mapping
document per scope is the reference's interchange format and is built with
``to_json`` — one document per file-like scope, so its size is bounded by one
file's distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the interchange format: the suffix of a masked file's stem and the JSON field that names it.
MASKED_STEM = "_redacted"
MASKED_FIELD = "redacted_file"

MAPPING_DOC_SCHEMA = (f"source_file string, {MASKED_FIELD} string, created string, spacy_ner_used boolean, "
                      "stats map<string,bigint>, mapping map<string,string>")

# Document kinds and the suffix of their masked / restored output.
MASKED_SUFFIX = {".docx": ".docx", ".odt": ".odt", ".xlsx": ".xlsx", ".pdf": ".txt"}
RESTORE_SUFFIX = {".docx": ".docx", ".odt": ".odt", ".xlsx": ".xlsx", ".txt": ".txt"}


def mapping_documents(registry: DataFrame, scope_cols: list[str], files: DataFrame | None = None,
                      entities_used: bool = False, scopes: DataFrame | None = None) -> DataFrame:
    """One JSON mapping document per scope.  ``registry`` has scope
    columns plus ``rule, original, pseudonym, first_pos``; ``files`` (scope
    columns, ``source_file``, ``masked_file``) names the files.  Every scope of
    ``files`` (or of ``scopes``) gets a document, with empty maps if it has no
    entry."""
    m = registry.groupBy(*scope_cols, "pseudonym").agg(
        F.max_by("original", "first_pos").alias("original"), F.min("first_pos").alias("o"))
    maps = m.groupBy(*scope_cols).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("o", "pseudonym", "original"))),
        lambda x: F.struct(x["pseudonym"], x["original"]))).alias("mapping"))
    st = registry.groupBy(*scope_cols, "rule").agg(F.count(F.lit(1)).alias("c"), F.min("first_pos").alias("o"))
    stats = st.groupBy(*scope_cols).agg(F.map_from_entries(F.transform(
        F.array_sort(F.collect_list(F.struct("o", "rule", "c"))), lambda x: F.struct(x["rule"], x["c"]))).alias("stats"))
    doc = maps.join(stats, scope_cols)
    known = files if files is not None else scopes
    if known is not None:
        doc = known.select(*scope_cols).distinct().join(doc, scope_cols, "left")
    doc = doc.withColumns({"mapping": F.coalesce("mapping", F.create_map().cast("map<string,string>")),
                           "stats": F.coalesce("stats", F.create_map().cast("map<string,bigint>"))})
    if files is not None:
        doc = doc.join(files.select(*scope_cols, "source_file", "masked_file"), scope_cols, "left")
    else:
        doc = doc.select("*", F.lit(None).cast("string").alias("source_file"),
                         F.lit(None).cast("string").alias("masked_file"))
    doc = doc.select(*scope_cols, F.to_json(F.struct(
        "source_file", F.col("masked_file").alias(MASKED_FIELD),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created"),
        F.lit(entities_used).alias("spacy_ner_used"), "stats", "mapping")).alias("json"))
    return doc


def read_mapping(docs: DataFrame, scope_cols: list[str], json_col: str = "json") -> DataFrame:
    """Mapping documents -> ``scope cols, pseudonym, original, order``.
    Documents without entries yield no rows (``plans.jobs.restore`` raises on an empty mapping)."""
    parsed = docs.select(*scope_cols, F.from_json(F.col(json_col), MAPPING_DOC_SCHEMA).alias("d"))
    return parsed.select(*scope_cols, F.posexplode(F.map_entries(F.col("d.mapping"))).alias("order", "x")).select(
        *scope_cols, F.col("x.key").alias("pseudonym"), F.col("x.value").alias("original"), "order")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def suffix(path: Column) -> Column:
    return F.regexp_extract(_name(path), "^.+(\\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    name = _name(path)
    return name.substr(F.lit(1), F.length(name) - F.length(suffix(path)))


def _suffix_map(sfx: Column, table: dict) -> Column:
    expr = None
    for k, v in table.items():
        expr = F.when(F.lower(sfx) == k, F.lit(v)) if expr is None else expr.when(F.lower(sfx) == k, F.lit(v))
    return expr


def mask_paths(input_path: Column, output: Column | None = None, mapping: Column | None = None) -> Column:
    """struct(supported, masked, mapping) derived from the input path;
    explicit paths win."""
    sfx = suffix(input_path)
    out_sfx = _suffix_map(sfx, MASKED_SUFFIX)
    derived_out = F.concat(_dir(input_path), stem(input_path), F.lit(MASKED_STEM), out_sfx)
    derived_map = F.concat(_dir(input_path), stem(input_path), F.lit("_mapping.json"))
    return F.struct(out_sfx.isNotNull().alias("supported"),
                    (F.coalesce(output, derived_out) if output is not None else derived_out).alias("masked"),
                    (F.coalesce(mapping, derived_map) if mapping is not None else derived_map).alias("mapping"))


def restore_paths(input_path: Column, output: Column | None = None, mapping: Column | None = None) -> Column:
    """struct(supported, restored, mapping); the mapping lookup drops one
    trailing ``MASKED_STEM`` from the stem."""
    sfx = suffix(input_path)
    out_sfx = F.coalesce(_suffix_map(sfx, RESTORE_SUFFIX), F.lower(sfx))
    st = stem(input_path)
    derived_out = F.concat(_dir(input_path), st, F.lit("_restored"), out_sfx)
    base = F.regexp_replace(st, f"{MASKED_STEM}$", "")
    derived_map = F.concat(_dir(input_path), base, F.lit("_mapping.json"))
    known = F.lower(sfx).isin(*MASKED_SUFFIX, ".txt")
    return F.struct(known.alias("supported"),
                    (F.coalesce(output, derived_out) if output is not None else derived_out).alias("restored"),
                    (F.coalesce(mapping, derived_map) if mapping is not None else derived_map).alias("mapping"))
