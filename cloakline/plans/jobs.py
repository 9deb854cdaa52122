"""Composite jobs (J1-J5): mask and restore DataFrames.

Texts stay where they are.  Spans are found per row; then

* when every unit has its own registry (``scope_cols`` are the key columns) the
  values are numbered and spliced inside the row: no exchange, nothing cached;
* when every scope has at most ``SCOPE_UNITS`` units and ``SCOPE_CHARS`` characters
  (measured), the units go to their scope's task once; there they are numbered by
  windows and put together again by row: one exchange, nothing cached;
* otherwise only spans travel: the hits (no text) are kept, numbered by a
  two-phase ranged count that spreads a scope of any size, joined with their
  pseudonyms (hot values salted) and regrouped per unit; then the units meet
  their hits by key, so every span is evaluated once.

A unit is matched by its key and a hash of its text, so rows that share a key
by mistake are still masked each by its own spans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import scan
from ..functions.templates import is_native
from ..functions.text import strip_ws
from ..operators import registry as reg
from ..operators.names import cells_to_table, mask_sheet, sheet_units
from ..operators.restore import local_restorer, restore_sequential, restore_tokens
from ..operators.spans import SPAN_T, detect
from ..operators.splice import splice
from ..rules import Rule, load_rules
from ..session import checkpointed, kept, spread_small, stored


@dataclass
class Masking:
    masked: DataFrame  # input columns, text replaced
    registry: DataFrame  # scope cols, rule, original, n, pseudonym, ...
    mapping: DataFrame  # scope cols, pseudonym, original
    stats: DataFrame  # scope cols, rule, count
    scope_cols: list
    internal: DataFrame = None  # registry with internal columns, for continuation (R9)
    cached: list = field(default_factory=list)

    def unpersist(self) -> None:
        """Release the cached hits and registry once outputs are written."""
        for df in self.cached:
            df.unpersist()


def scope_struct(scope_cols: list[str] | None):
    if scope_cols:
        return F.struct(*[F.col(c) for c in scope_cols])
    return F.struct(F.lit(0).alias("corpus"))


def to_units(df: DataFrame, text_col: str, key_cols: list[str], scope_cols: list[str] | None = None,
             order_col: str | None = None) -> DataFrame:
    """Add ``_scope`` / ``_unit`` (unit identity and first-seen order) and
    ``_text``; other columns ride along untouched."""
    unit = F.col(order_col) if order_col else F.struct(*[F.col(c) for c in key_cols])
    # the text travels once, as _text (callers rename it back)
    rest = [c for c in df.columns if c != text_col]
    return df.select(*rest, scope_struct(scope_cols).alias("_scope"), unit.alias("_unit"),
                     F.col(text_col).alias("_text"))


def entity_lists(entities: DataFrame, key_cols: list[str], scope_cols: list[str] | None) -> DataFrame:
    """Entities ``(key cols, s, e, label)`` -> one sorted list per unit."""
    ent = F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e"),
                   F.col("label").alias("label"))
    return (entities.select(scope_struct(scope_cols).alias("_scope"),
                            F.struct(*[F.col(c) for c in key_cols]).alias("_unit"), ent.alias("x"))
            .groupBy("_scope", "_unit").agg(F.array_sort(F.collect_list("x")).alias("_ents")))


#: entity lists up to about this many bytes go to the texts, beyond it the texts are shuffled
ENTITY_BYTES = 64_000_000


def with_entities(units: DataFrame, entities: DataFrame) -> DataFrame:
    """``units`` with the lists of :func:`entity_lists`, which are far smaller than the
    texts: measured, and sent to the texts if they may be."""
    lists = kept(entities)
    size = lists.agg(F.sum(64 + F.length(F.to_json(F.struct("_scope", "_unit", "_ents"))))).first()[0] or 0
    return units.join(F.broadcast(lists) if size <= ENTITY_BYTES else lists, ["_scope", "_unit"], "left")


def scope_columns(df: DataFrame, scope_cols: list[str] | None) -> DataFrame:
    """Flatten ``_scope`` back into the caller's scope columns."""
    if scope_cols:
        return df.select(*[F.col("_scope")[c].alias(c) for c in scope_cols],
                         *[c for c in df.columns if c != "_scope"])
    return df.drop("_scope")


#: scopes up to this size are numbered by the task that has them
SCOPE_UNITS, SCOPE_CHARS = 100_000, 16_000_000
UNIT = ["_scope", "_unit", "_h"]
HAS_SPANS = "size(_spans) > 0 AND _b >= 0"


def with_barrier(spanned: DataFrame) -> DataFrame:
    """A column that a filter on the spans also reads: it is not deterministic, so
    the optimizer leaves the filter above the span projections.  Pushed below
    them it would evaluate every rule level anew for each reference."""
    return spanned.withColumn("_b", F.monotonically_increasing_id())


def opaque(text: Column) -> Column:
    """The same value, formally not deterministic: a later filter on the masked
    text stays above it instead of repeating the whole chain of rule levels."""
    return F.when(F.monotonically_increasing_id() >= 0, text)


def in_row_pseudonyms(spans: Column, rules: list[Rule]) -> Column:
    """Spans with pseudonyms, numbered within the row: a value's number is its
    place among the rule's distinct values in order of (rule, start).  Sorted by
    value, the first span of a value is its first occurrence; sorted by that, a
    value's number is the count of values so far.  n spans cost two sorts."""
    names = list(dict.fromkeys(r.name for r in rules))
    of_rule = F.array(*[F.lit(names.index(r.name)) for r in rules])
    by_value = F.sort_array(F.transform(spans, lambda x: F.struct(
        F.element_at(of_rule, x["k"] + 1).alias("m"), strip_ws(x["v"]).alias("key"), x["k"].alias("k"), x["s"].alias("s"),
        x["e"].alias("e"), x["v"].alias("v"))))

    def first(st: Column, x: Column) -> tuple[Column, Column]:
        here = F.struct(x["m"].alias("m"), x["key"].alias("key"), x["k"].alias("k"), x["s"].alias("s"), x["v"].alias("v"))
        of = F.when((st["m"] == x["m"]) & (st["key"] == x["key"]), st).otherwise(here)
        return of, F.array(F.struct(x["m"].alias("m"), of["k"].alias("fk"), of["s"].alias("fs"), x["s"].alias("s"), x["e"].alias("e"), of["v"].alias("fv")))

    def count(st: Column, x: Column) -> tuple[Column, Column]:
        same = (st["fk"] == x["fk"]) & (st["fs"] == x["fs"])
        n = F.when(st["m"] != x["m"], 1).when(same, st["n"]).otherwise(st["n"] + 1)
        return (F.struct(x["m"].alias("m"), x["fk"].alias("fk"), x["fs"].alias("fs"), n.alias("n")),
                F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n"), x["fk"].alias("fk"), x["fv"].alias("fv"))))

    none = F.struct(F.lit(-1).alias("m"), F.lit("").alias("key"), F.lit(0).alias("k"), F.lit(0).alias("s"), F.lit("").alias("v"))
    firsts = scan(by_value, none, "array<struct<m:int,fk:int,fs:int,s:int,e:int,fv:string>>", first)
    none = F.struct(F.lit(-1).alias("m"), F.lit(0).alias("fk"), F.lit(0).alias("fs"), F.lit(0).alias("n"))
    numbered = scan(F.sort_array(firsts), none, "array<struct<s:int,e:int,n:int,fk:int,fv:string>>", count)
    return F.when(F.size(spans) > 0, F.transform(F.sort_array(numbered), lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), reg.pseudonym_column(rules, x["n"], x["fv"], x["fk"]).alias("pseudonym"))))


def masked_units(units: DataFrame, rules: list[Rule], entities: DataFrame | None = None, use_entities: bool = True,
                 prior: DataFrame | None = None, own_scope: bool = False) -> dict:
    """Core of J1 on prepared units (``_scope, _unit, _text``, ...): the masked
    units, the registry, and the cached frames to release afterwards."""
    ents_col = None
    if entities is not None:
        units = with_entities(units, entities)
        ents_col = "_ents"
    spanned = detect(units.withColumn("_h", F.xxhash64("_text")), rules, "_text", ents_col, use_entities)
    if ents_col:
        spanned = spanned.drop(ents_col)
    if own_scope and prior is None and all(is_native(r.template) for r in rules):
        # one exchange, of the spans of each unit: grouping and numbering stay in its scope
        mine = with_barrier(spanned).where(HAS_SPANS).select(*UNIT, "_spans").repartition("_scope")
        registry = reg.build_registry(reg.occurrences(mine, rules), rules, "window")
        # a column of its own: splice reads it several times, also inside a lambda
        out = spanned.withColumn("_repl", in_row_pseudonyms(F.col("_spans"), rules))
        out = out.withColumn("_text", opaque(splice(F.col("_text"), F.col("_repl"))))
        return {"units": out.drop("_spans", "_h", "_repl"), "registry": registry, "cached": []}
    hits = with_barrier(spanned).where(HAS_SPANS).select(*UNIT, "_spans").persist(StorageLevel.MEMORY_AND_DISK)  # spans only: read for the registry and for the join
    occ = reg.occurrences(hits, rules)
    registry = reg.build_registry(occ, rules) if prior is None else reg.continue_registry(prior, occ, rules)
    registry = registry.persist(StorageLevel.MEMORY_AND_DISK)
    out = spliced(spanned.drop("_spans"), reg.attach_pseudonyms(occ, registry, UNIT))
    return {"units": out.drop("_h"), "registry": registry, "cached": [hits, registry]}


def small_scopes(units: DataFrame) -> bool:
    """Has every scope few units and characters?"""
    sizes = units.groupBy("_scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("_text")).alias("c"))
    most = sizes.agg(F.max("n").alias("n"), F.max("c").alias("c")).first()
    return (most["n"] or 0) <= SCOPE_UNITS and (most["c"] or 0) <= SCOPE_CHARS


def masked_by_scope(units: DataFrame, rules: list[Rule]) -> dict:
    """Core of J1 for small scopes.  Hits stay in the partition of their scope: a
    value's first occurrence and its number come from windows, and a row gets its
    hits back by its number.  Its other columns travel with its first hit only."""
    spanned = detect(units.repartition("_scope").withColumn("_unit_row", F.monotonically_increasing_id()), rules)
    rest = F.struct(*[F.col(f"`{c}`") for c in units.columns if c != "_scope"])
    # never empty, and explode_outer: see occurrences
    none = F.array(F.struct(F.lit(-1).alias("i"), F.lit(None).cast(SPAN_T[len("array<"):-1]).alias("h")))
    each = F.when(F.size("_spans") > 0, F.transform("_spans", lambda x, i: F.struct(i.alias("i"), x.alias("h")))).otherwise(none)
    hits = (spanned.select("_scope", "_unit", "_unit_row", rest.alias("_rest"), F.explode_outer(each).alias("x"))
            .withColumn("_rest", F.when(F.col("x.i") <= 0, F.col("_rest"))))
    h = F.col("x.h")
    name = F.when(h.isNotNull(), F.element_at(reg.rule_names(rules), F.coalesce(h["k"], F.lit(0)) + 1))  # element_at takes no null for a place
    hits = hits.select("_scope", "_unit_row", "_rest", h["s"].alias("s"), h["e"].alias("e"), name.alias("rule"), strip_ws(h["v"]).alias("key"),
                       F.struct(F.struct(F.col("_unit").alias("u"), h["k"].alias("k"), h["s"].alias("s")).alias("pos"), h["v"].alias("v"), h["k"].alias("k")).alias("f"))
    hits = hits.withColumn("f", F.min("f").over(Window.partitionBy("_scope", "rule", "key")))
    hits = hits.withColumn("n", F.dense_rank().over(Window.partitionBy("_scope", "rule").orderBy("f.pos", "key")).cast("bigint"))
    hit = F.struct("s", "e", reg.pseudonym_column(rules, F.col("n"), F.col("f.v"), F.col("f.k")).alias("pseudonym"))
    out = hits.groupBy("_scope", "_unit_row").agg(F.first("_rest", ignorenulls=True).alias("_rest"),
                                             F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), hit))).alias("_repl"))
    out = out.select("_scope", "_rest.*", "_repl").withColumn("_text", opaque(splice(F.col("_text"), F.col("_repl"))))
    mine = with_barrier(detect(units.withColumn("_h", F.xxhash64("_text")), rules)).where(HAS_SPANS).select(*UNIT, "_spans").repartition("_scope")
    registry = reg.build_registry(reg.occurrences(mine, rules), rules, "window")
    return {"units": out.select(*units.columns), "registry": registry.withColumn("n", F.col("n").cast("bigint")), "cached": []}


def spliced(units: DataFrame, hits: DataFrame) -> DataFrame:
    """Units with their hits (``UNIT``, s, e, pseudonym) replaced; the spans are not
    evaluated again.  A set per unit: repeated rows of one key and text give the
    same hits twice."""
    repl = hits.groupBy(*UNIT).agg(F.array_sort(F.collect_set(F.struct("s", "e", "pseudonym"))).alias("_repl"))
    out = units.join(repl, UNIT, "left")
    return out.withColumn("_text", opaque(splice(F.col("_text"), F.col("_repl")))).drop("_repl")


def mask(df: DataFrame, text_col: str, key_cols: list[str], scope_cols: list[str] | None = None,
         rules: list[Rule] | None = None, proper_nouns: bool = False, entities: DataFrame | None = None,
         use_entities: bool = True, order_col: str | None = None, prior: Masking | None = None) -> Masking:
    """Mask ``text_col`` of ``df``.

    ``key_cols`` identify a unit and give the first-seen order inside a scope;
    ``scope_cols`` choose the registry (one per distinct value — e.g. one per
    file), none means one corpus-wide registry.  ``prior`` continues the
    registry of an earlier batch (R9): known values keep their pseudonyms."""
    rules = rules if rules is not None else load_rules(proper_nouns=proper_nouns)
    units = to_units(spread_small(df), text_col, key_cols, scope_cols, order_col)
    ents = entity_lists(entities, key_cols, scope_cols) if entities is not None else None
    own_scope = bool(scope_cols) and set(key_cols) <= set(scope_cols)
    if scope_cols and not own_scope and prior is None and ents is None and all(is_native(r.template) for r in rules) and small_scopes(units):
        res = masked_by_scope(units, rules)
    else:
        res = masked_units(units, rules, ents, use_entities, prior.internal if prior is not None else None, own_scope=own_scope)
    registry = res["registry"]
    return Masking(
        masked=res["units"].withColumn(text_col, F.col("_text")).select(*df.columns),
        registry=scope_columns(registry.select(
            "_scope", "rule", F.col("key").alias("original"), "n", "pseudonym", "first_pos",
            "first_v", "first_k", "occurrences"), scope_cols),
        mapping=scope_columns(reg.mapping(registry), scope_cols),
        stats=scope_columns(reg.stats(registry), scope_cols),
        scope_cols=scope_cols or [],
        internal=registry,
        cached=res["cached"],
    )


def require_entries(mapping: DataFrame) -> None:
    """Restoring needs a mapping with entries."""
    if mapping.isEmpty():
        raise ValueError("the mapping is empty: nothing can be restored")


def restore(df: DataFrame, text_col: str, key_cols: list[str], mapping: DataFrame,
            scope_cols: list[str] | None = None, mode: str = "sequential") -> DataFrame:
    """Restore ``text_col`` of ``df`` from a mapping
    (``scope cols, pseudonym, original, order``).  An empty mapping is an error."""
    # opaque: the text's own expressions are not to be copied into the Python calls below
    units = to_units(spread_small(df), text_col, key_cols, scope_cols).withColumn("_text", opaque(F.col("_text")))
    # read several times below, and often the end of a long plan: written once
    m, _ = stored(mapping.select(scope_struct(scope_cols).alias("_scope"), "pseudonym", "original",
                                 *[c for c in ("order",) if c in mapping.columns]))
    require_entries(m)
    own_scope = bool(scope_cols) and set(key_cols) <= set(scope_cols)
    if mode == "sequential":
        if "order" not in m.columns:
            raise ValueError("sequential restore needs the mapping's 'order' column")
        out = restore_sequential(units, m, own_scope=own_scope)
    elif mode == "single_pass":
        out = restore_tokens(units, m, own_scope=own_scope)
    else:
        raise ValueError(f"unknown restore mode {mode!r}")
    return out.withColumn(text_col, F.col("_text")).select(*df.columns)


def applied_entries(mapping: DataFrame, scope_cols: list[str] | None = None) -> DataFrame:
    """How many mapping entries a restore works with, per scope."""
    return mapping.groupBy(*(scope_cols or [])).agg(F.count("*").alias("entries"))


@dataclass
class TableMasking:
    masked: DataFrame  # the wide table, string cells masked
    header: DataFrame  # col, text: header cells after masking
    registry: DataFrame
    mapping: DataFrame
    internal: DataFrame = None  # registry with internal columns (next sheet continues it)
    sheet: int = 0
    cached: list = field(default_factory=list)

    def unpersist(self) -> None:
        for df in self.cached:
            df.unpersist()


def _public(registry: DataFrame) -> DataFrame:
    return registry.select("rule", F.col("key").alias("original"), "n", "pseudonym", "first_pos", "first_v", "first_k", "occurrences")


def mask_table(df: DataFrame, row_col: str, rules: list[Rule] | None = None, multi_col_names: bool = False,
               proper_nouns: bool = False, prior: TableMasking | None = None) -> TableMasking:
    """J3 (and S8): mask every string cell of a wide table — header row
    included, other types untouched — with one registry for the table.  With
    ``multi_col_names`` the split-name pre-scan and component fallback run
    (M1-M6).  ``prior``: the previous sheet of the same workbook (shared
    registry, S8)."""
    rules = rules if rules is not None else load_rules(proper_nouns=proper_nouns)
    sheet = prior.sheet + 1 if prior is not None else 0
    units = sheet_units(df, row_col, sheet, multi_col_names).withColumn("_scope", scope_struct(None))
    res = mask_sheet(units, rules, multi_col_names, prior=prior.internal if prior is not None else None)
    cells, registry = res["cells"], res["registry"]
    return TableMasking(
        masked=cells_to_table(df, cells, row_col),
        header=cells.where(F.col("_unit.hdr") == 0).select("col", F.col("_text").alias("text")),
        registry=_public(registry), mapping=scope_columns(reg.mapping(registry), None),
        internal=registry, sheet=sheet, cached=res["cached"])


def mask_workbook(sheets: list[tuple[DataFrame, str]], rules: list[Rule] | None = None,
                  multi_col_names: bool = False, proper_nouns: bool = False) -> list[TableMasking]:
    """All sheets of a workbook with one registry (S8, M6), numbered in one
    pass in (sheet, phase, row, cell) order: no loop over sheets, component
    words decided per sheet from the values registered before its cells."""
    rules = rules if rules is not None else load_rules(proper_nouns=proper_nouns)
    units = None
    for j, (df, row_col) in enumerate(sheets):
        u = sheet_units(df, row_col, j, multi_col_names)
        units = u if units is None else units.unionByName(u)
    units = units.withColumn("_scope", scope_struct(None))
    res = mask_sheet(units, rules, multi_col_names)
    # read once per sheet below: a reliable checkpoint keeps each sheet's plan
    # small (otherwise every branch carries the whole plan)
    cells, registry = checkpointed(res["cells"]), res["registry"]
    mapping = scope_columns(reg.mapping(registry), None)
    out = []
    for j, (df, row_col) in enumerate(sheets):
        mine = cells.where(F.col("_unit.sheet") == j)
        out.append(TableMasking(
            masked=cells_to_table(df, mine, row_col),
            header=mine.where(F.col("_unit.hdr") == 0).select("col", F.col("_text").alias("text")),
            registry=_public(registry), mapping=mapping, internal=registry, sheet=j, cached=res["cached"]))
    return out


def restore_table(df: DataFrame, row_col: str, mapping: DataFrame, mode: str = "sequential") -> DataFrame:
    """T2 for a wide table: every string cell restored, other types untouched.  With
    a mapping that may go to the workers whole the cells are restored where they
    stand; otherwise they become units, meet their entries and are pivoted back."""
    from ..sources.units import cell_units

    strs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != row_col]
    if not strs:
        require_entries(mapping)
        return df
    if mode == "sequential":
        m = checkpointed(mapping.select(scope_struct(None).alias("_scope"), "pseudonym", "original", "order")
                         .where(F.col("pseudonym").isNotNull() & (F.col("pseudonym") != "")))
        require_entries(m)
        local = local_restorer(m)
        if local is not None:
            rows = df.select([opaque(F.col(f"`{c}`")).alias(c) if c in strs else F.col(f"`{c}`") for c in df.columns])
            return rows.select([local(F.col(f"`{c}`"), scope_struct(None)).alias(c) if c in strs else F.col(f"`{c}`") for c in df.columns])
    cells = cell_units(df, row_col).where(F.col("text").isNotNull()).select(F.col(row_col), "col", "text")
    back = restore(cells, "text", [row_col, "col"], mapping, None, mode)
    wide = back.groupBy(row_col).agg(*[F.max(F.when(F.col("col") == c, F.col("text"))).alias(c) for c in strs])
    rest = [c for c in df.columns if c not in strs]
    return df.select(*rest).join(wide, row_col, "left").select(*df.columns)


def restore_workbook(sheets: list[tuple[DataFrame, str]], mapping: DataFrame, mode: str = "sequential") -> list[DataFrame]:
    """T2 for the sheets of a workbook: one mapping for all."""
    return [restore_table(df, row_col, mapping, mode) for df, row_col in sheets]


def restore_text_files(spark, paths: str, mapping: DataFrame, mode: str = "sequential") -> DataFrame:
    """Restore plain-text files, each file one unit (``wholetext``).

    ``mapping``: ``file, pseudonym, original, order`` where ``file`` is the
    masked file's path as Spark reports it (``input_file_name``)."""
    files = (spark.read.text(paths, wholetext=True)
             .select(F.input_file_name().alias("file"), F.col("value").alias("text")))
    return restore(files, "text", ["file"], mapping, ["file"], mode=mode)


def mask_lines(pages: DataFrame, file_cols: list[str], page_col: str | None, text_col: str,
               rules: list[Rule] | None = None, proper_nouns: bool = False):
    """S9 job: every line masked on its own, one registry per file; returns
    ``(file text DataFrame, Masking of the lines)``."""
    from ..sources.units import line_units, page_text

    lines = line_units(pages, file_cols, page_col, text_col)
    r = mask(lines, "text", ["page_no", "line_no"], file_cols, rules=rules, proper_nouns=proper_nouns)
    page_list = pages.select(*file_cols, (F.col(page_col) if page_col else F.lit(1)).alias("page_no"))
    return page_text(r.masked, page_list, file_cols), r


def mask_runs(runs: DataFrame, para_cols: list[str], run_col: str, text_col: str,
              scope_cols: list[str] | None = None, rules: list[Rule] | None = None, proper_nouns: bool = False):
    """S5 job: paragraphs made of runs; returns ``(runs written back, Masking)``."""
    from ..sources.units import paragraph_units, paragraph_write_back

    paras = paragraph_units(runs, para_cols, run_col, text_col)
    r = mask(paras, "text", para_cols, scope_cols, rules=rules, proper_nouns=proper_nouns)
    return paragraph_write_back(runs, paras, r.masked, para_cols, run_col, text_col), r


def restore_runs(runs: DataFrame, para_cols: list[str], run_col: str, text_col: str, mapping: DataFrame,
                 scope_cols: list[str] | None = None, mode: str = "sequential") -> DataFrame:
    """T2 for paragraphs made of runs: the paragraph is restored as one text and
    written back like a masked one."""
    from ..sources.units import paragraph_units, paragraph_write_back

    paras = paragraph_units(runs, para_cols, run_col, text_col)
    back = restore(paras, "text", para_cols, mapping, scope_cols, mode)
    return paragraph_write_back(runs, paras, back, para_cols, run_col, text_col)


def mask_nodes(nodes: DataFrame, key_cols: list[str], text_col: str, scope_cols: list[str] | None = None,
               rules: list[Rule] | None = None, proper_nouns: bool = False):
    """S7 job: text nodes of documents masked one by one and put back between
    the markup; returns ``(documents, Masking of the nodes)``."""
    from ..sources.units import node_units, node_write_back

    units = node_units(nodes, key_cols, text_col)
    r = mask(units, "text", [*key_cols, "node_no"], scope_cols, rules=rules, proper_nouns=proper_nouns)
    return node_write_back(nodes, units, r.masked, key_cols, text_col), r


def restore_nodes(nodes: DataFrame, key_cols: list[str], text_col: str, mapping: DataFrame,
                  scope_cols: list[str] | None = None, mode: str = "sequential") -> DataFrame:
    """T2 for marked-up documents: text nodes restored one by one, so that a
    placeholder that stands in a tag, comment or script is left alone."""
    from ..sources.units import node_units, node_write_back

    units = node_units(nodes, key_cols, text_col)
    back = restore(units, "text", [*key_cols, "node_no"], mapping, scope_cols, mode)
    return node_write_back(nodes, units, back, key_cols, text_col)


def mask_kind(df: DataFrame, kind: str, **options):
    """Dispatch on the unit kind — ``text`` (one unit per row), ``lines``
    (pages split into lines), ``fragments`` (paragraph runs), ``cells`` (wide
    table), ``nodes`` (text between markup); an unknown kind is an error."""
    from ..sources.units import check_kind

    check_kind(kind)
    jobs = {"text": mask, "lines": mask_lines, "fragments": mask_runs, "cells": mask_table, "nodes": mask_nodes}
    return jobs[kind](df, **options)


def restore_kind(df: DataFrame, kind: str, **options) -> DataFrame:
    """S4 for restoring: ``text`` and ``lines`` (a page's or file's whole text is
    one unit), ``fragments``, ``cells``, ``nodes``; an unknown kind is an error."""
    from ..sources.units import check_kind

    check_kind(kind)
    jobs = {"text": restore, "lines": restore, "fragments": restore_runs, "cells": restore_table, "nodes": restore_nodes}
    return jobs[kind](df, **options)
