"""Names split over several columns of a wide table (M1-M6).

Per sheet, in numbering order:

* phase 0 — pre-scan units: every data row's non-blank string cells joined
  with a space (M1), then one unit per first/middle/last column group found
  from the header names (M2/M3);
* component words (M4): words (2+ characters) of multi-word values that the
  pre-scan registered under a name-like rule, kept when a word-boundary search
  hits exactly one such value — an equi-join on the word's first ``\\w+`` run
  against the values' runs, verified by regex, counted per word;
* phase 1 — every string cell, header row first.  A cell left without any
  span whose stripped text is a component word becomes one ``name`` value of
  its own (M5); those events join the ordinary ones in one numbering pass.

Component values never contain a space, so they never feed back into the
source set; the whole sheet is numbered in a single registry pass.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, WS, is_blank, split_ws, strip_ws
from ..rules import Rule
from ..session import checkpointed, spread_small
from . import registry as reg
from .spans import detect
from .splice import splice

# Header aliases (lower-cased, stripped) of name columns.
FIRST_NAME_HEADERS = frozenset({"first name", "firstname", "forename", "given name", "christian name", "first"})
LAST_NAME_HEADERS = frozenset({"last name", "lastname", "surname", "family name", "second name", "last"})
MIDDLE_NAME_HEADERS = frozenset({"middle name", "middle", "middle initial"})

NAME_LIKE_RULES = ("name", "proper_noun")


_HEADER_SLOT = {h: slot for slot, aliases in (("first", FIRST_NAME_HEADERS), ("middle", MIDDLE_NAME_HEADERS), ("last", LAST_NAME_HEADERS))
                for h in aliases}


def name_column_triples(headers: list) -> list[tuple]:
    """M2: ``(first, middle or None, last)`` column positions.  The i-th first
    column goes with the i-th last column; a middle column counts if it stands
    between the two, the first such one."""
    slots: dict[str, list[int]] = {"first": [], "middle": [], "last": []}
    for place, header in enumerate(headers):
        slot = _HEADER_SLOT.get(str(header or "").strip().lower())
        if slot:
            slots[slot].append(place)
    return [(a, next((m for m in slots["middle"] if a < m < z), None), z) for a, z in zip(slots["first"], slots["last"])]


def _joined(cells: list) -> F.Column:
    """Non-blank string cells joined by one space (null when none)."""
    arr = F.filter(F.array(*cells), lambda x: ~is_blank(x))
    return F.when(F.size(arr) > 0, F.array_join(arr, " "))


def sheet_units(df: DataFrame, row_col: str, sheet: int = 0, multi_col_names: bool = True) -> DataFrame:
    """Units of one sheet: ``_unit = (sheet, phase, hdr, row, sub)``,
    ``_text``, ``_cell`` (phase-1 flag), ``col``.  A table of few bytes is dealt over
    the cores before its rows become several units each."""
    df = spread_small(df)
    cols = [c for c in df.columns if c != row_col]
    strs = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"} - {row_col}
    idx = {c: i for i, c in enumerate(cols)}
    row_t = df.schema[row_col].dataType.simpleString()

    def unit(phase, hdr, row, sub):
        return F.struct(F.lit(sheet).alias("sheet"), F.lit(phase).alias("phase"), F.lit(hdr).alias("hdr"),
                        row.alias("row"), F.lit(sub).alias("sub"))

    cells = df.select(F.explode(F.array(*[
        F.struct(unit(1, 1, F.col(row_col), idx[c]).alias("_unit"), F.col(c).alias("_text"),
                 F.lit(c).alias("col")) for c in cols if c in strs])).alias("x")).select("x.*")
    header = df.sparkSession.createDataFrame([(c, idx[c]) for c in cols], "col string, sub int").select(
        F.struct(F.lit(sheet).alias("sheet"), F.lit(1).alias("phase"), F.lit(0).alias("hdr"),
                 F.lit(None).cast(row_t).alias("row"), F.col("sub")).alias("_unit"),
        F.col("col").alias("_text"), "col")
    units = header.unionByName(cells).withColumn("_cell", F.lit(True))
    if not multi_col_names:
        return units
    pre = [F.struct(unit(0, 1, F.col(row_col), 0).alias("_unit"),
                    _joined([F.col(c) for c in cols if c in strs]).alias("_text"))]
    for t, (f, m, last) in enumerate(name_column_triples(cols)):
        parts = [F.col(cols[i]) for i in (f, m, last) if i is not None and cols[i] in strs]
        arr = F.filter(F.array(*parts), lambda x: ~is_blank(x))
        pre.append(F.struct(unit(0, 1, F.col(row_col), t + 1).alias("_unit"),
                            F.when(F.size(arr) >= 2, F.array_join(arr, " ")).alias("_text")))
    prescan = (df.select(F.explode(F.array(*pre)).alias("x")).select("x.*")
               .where(F.col("_text").isNotNull())
               .select("_unit", "_text", F.lit(None).cast("string").alias("col"), F.lit(False).alias("_cell")))
    return units.unionByName(prescan)


def _sheet_phase(pos) -> F.Column:
    """Registration stage of a first position: 2 * sheet + phase."""
    return pos["u"]["sheet"] * 2 + pos["u"]["phase"]


def component_table(sources: DataFrame, rules: list[Rule]) -> DataFrame:
    """M4 for every sheet at once: ``_scope, word, lo, hi``.

    ``sources``: registry keys ``_scope, rule, key, stage`` (``stage`` =
    2 * sheet + phase of their first registration).  A word (2+ characters)
    is a component for the cells of sheet ``j`` when the values registered
    before that sheet's cell phase (stage <= 2j) include a value having the
    word as one of its words, and a word-boundary search for it hits exactly
    one of them: ``lo <= 2j < hi`` with ``lo`` the stage of its first hit
    (which must be a value the word comes from) and ``hi`` the stage of the
    second hit (null when there is none).

    A word that is one run of word characters is hit by exactly the values that
    have it as a run: its two smallest hits come from an aggregate over
    (run, value), no pairs.  Only words with inner punctuation are searched for
    in values, and only in those that hold their rarest run."""
    eligible = [r.name for r in rules if r.entity or r.name in NAME_LIKE_RULES]
    src = (sources.where(F.col("rule").isin(eligible) & F.col("key").contains(" "))
           .groupBy("_scope", "rule", "key").agg(F.min("stage").alias("stage")))
    src = checkpointed(src)  # names only; read for runs and for words
    hit = F.struct("stage", "rule", "key")
    run = f"[{WORD}]+"
    pieces = F.array_distinct(F.concat(F.regexp_extract_all("key", F.lit(run), F.lit(0)),
                                       F.split(F.regexp_replace("key", f"[{WORD}\\s]", ""), "")))
    # per run (or lone punctuation character): how many values hold it, and the two first
    of_run = src.select("_scope", hit.alias("h"), F.explode(pieces).alias("run")).where("run <> ''")
    runs = checkpointed(two_smallest(of_run, ["_scope", "run"]))
    origin = (src.select("_scope", hit.alias("h"), F.explode(F.array_distinct(split_ws("key"))).alias("word"))
              .where(F.length("word") >= 2).groupBy("_scope", "word").agg(F.min("h").alias("q")))
    plain = F.col("word").rlike(f"^{run}$")
    simple = (origin.where(plain).join(runs.withColumnRenamed("run", "word"), ["_scope", "word"])
              .select("_scope", "word", "q", "p1", "p2"))
    # words with inner punctuation, posted at their rarest piece
    parts = F.array_distinct(F.concat(F.regexp_extract_all("word", F.lit(run), F.lit(0)),
                                      F.filter(F.split(F.regexp_replace("word", run, ""), ""), lambda x: x != "")))
    odd = origin.where(~plain).select("_scope", "word", "q", F.explode(parts).alias("run"))
    odd = (odd.join(runs.select("_scope", "run", "n"), ["_scope", "run"])
           .groupBy("_scope", "word").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.first("q").alias("q")))
    quoted = F.concat(F.lit("\\Q"), F.replace(F.col("word"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(f"(?<![{WORD}])"), quoted, F.lit(f"(?![{WORD}])"))
    found = (odd.withColumn("_pat", pattern).join(of_run, ["_scope", "run"]).where(F.expr("h.key rlike _pat"))
             .select("_scope", "word", "q", "h"))
    odd_hits = two_smallest(found.select("_scope", "word", "h"), ["_scope", "word"])
    odd = odd.select("_scope", "word", "q").join(odd_hits, ["_scope", "word"]).select("_scope", "word", "q", "p1", "p2")
    return checkpointed(simple.unionByName(odd).where(F.col("q") == F.col("p1"))
                        .select("_scope", "word", F.col("p1.stage").alias("lo"), F.col("p2.stage").alias("hi")))


def two_smallest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: the number of rows and the two smallest ``h`` (distinct per key),
    by partial aggregation (no sort of a group): min, then min of the others."""
    first = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("h").alias("p1"))
    more = (rows.join(first.where("n > 1").select(*keys, "p1"), keys).where(F.col("h") > F.col("p1"))
            .groupBy(*keys).agg(F.min("h").alias("p2")))
    return first.join(more, keys, "left")


def component_words(keys: DataFrame, rules: list[Rule]) -> DataFrame:
    """M4 for one set of registered values (all before the cells):
    ``_scope, word``."""
    comps = component_table(keys.withColumn("stage", F.lit(0)), rules)
    return comps.where(F.col("hi").isNull()).select("_scope", "word")


def mask_sheet(units: DataFrame, rules: list[Rule], multi_col_names: bool, prior: DataFrame | None = None) -> dict:
    """Number one workbook's events (spans + component fallbacks; any number
    of sheets, ``_unit.sheet`` gives their order) in one pass and splice the
    cells.  ``units``: ``_scope, _unit, _text, _cell, col``.  ``prior`` is the
    registry left by earlier sheets (values keep their pseudonyms, take part
    in component words, counters continue).  The component fallback runs only
    with ``multi_col_names``, and not for a sheet that is a header only."""
    from ..plans.jobs import UNIT

    # cells are short: the spans of a sheet are kept with them and read for the
    # registry, the fallback and the splice
    spanned = detect(units.withColumn("_h", F.xxhash64("_text")), rules).persist(StorageLevel.MEMORY_AND_DISK)
    occ = reg.occurrences(spanned, rules)
    name_k = next((k for k, r in enumerate(rules) if r.name == "name"), None)
    events = occ
    if multi_col_names and name_k is not None:
        sources = reg.first_seen(occ).select("_scope", "rule", "key", _sheet_phase(F.col("first_pos")).alias("stage"))
        if prior is not None:
            sources = sources.unionByName(prior.select("_scope", "rule", "key",
                                                       _sheet_phase(F.col("first_pos")).alias("stage")))
        comps = component_table(sources, rules).withColumnRenamed("word", "_word")
        filled = spanned.where(F.col("_cell") & (F.col("_unit.hdr") == 1)).select(F.col("_unit.sheet").alias("_sheet")).distinct()
        bare = (spanned.where(F.col("_cell") & (F.size("_spans") == 0) & ~is_blank(F.col("_text")))
                .withColumn("_word", strip_ws("_text")).where((F.length("_word") >= 2) & ~F.col("_word").rlike(f"[{WS}]"))
                .withColumn("_sheet", F.col("_unit.sheet")).join(F.broadcast(filled), "_sheet", "left_semi"))  # a row a sheet
        # distinct words first: a status word in every row is one row here, and only components go on
        asked = checkpointed(bare.select("_scope", "_word").distinct().join(comps, ["_scope", "_word"]))
        stage = F.col("_unit.sheet") * 2  # components are fixed before the sheet's cell phase
        counts = bare.groupBy("_scope", "_word").agg(F.count("*").alias("n")).join(asked, ["_scope", "_word"], "left_semi")
        fb = (reg.salted_join(bare, asked, ["_scope", "_word"], reg.hot_keys(counts, ["_scope", "_word"], "n"), ["_unit"])
              .where((F.col("lo") <= stage) & (F.col("hi").isNull() | (F.col("hi") > stage)))
              .select("_scope", "_unit", "_h", F.lit(0).alias("s"), F.length("_text").alias("e"),
                      F.lit(name_k).alias("k"), F.col("_word").alias("v"), F.lit("name").alias("rule"),
                      F.col("_word").alias("key"),
                      F.struct(F.col("_unit").alias("u"), F.lit(name_k).alias("k"), F.lit(0).alias("s")).alias("pos")))
        events = occ.unionByName(fb)
    registry = reg.build_registry(events, rules) if prior is None else reg.continue_registry(prior, events, rules)
    registry = registry.persist(StorageLevel.MEMORY_AND_DISK)
    cell_events = events.where(F.col("pos.u.phase") == 1)
    hits = reg.attach_pseudonyms(cell_events, registry, UNIT)
    repl = hits.groupBy(*UNIT).agg(F.array_sort(F.collect_set(F.struct("s", "e", "pseudonym"))).alias("_repl"))
    cells = spanned.where("_cell").join(repl, UNIT, "left")
    cells = cells.withColumn("_text", splice(F.col("_text"), F.col("_repl"))).drop("_repl", "_spans", "_h")
    return {"cells": cells, "registry": registry, "cached": [spanned, registry]}


def cells_to_table(df: DataFrame, cells: DataFrame, row_col: str) -> DataFrame:
    """Pivot masked data cells back onto the sheet's rows."""
    strs = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != row_col]
    data = cells.where(F.col("_unit.hdr") == 1).select(F.col("_unit.row").alias(row_col), "col", "_text")
    back = data.groupBy(row_col).agg(*[F.max(F.when(F.col("col") == c, F.col("_text"))).alias(c) for c in strs])
    rest = [c for c in df.columns if c not in strs]
    return df.select(*rest).join(back, row_col, "left").select(*df.columns)
