"""Span detection (D1-D7) and first-claim-wins overlap resolution (O1-O2).

Everything is per-row Column work: no shuffle, one route for texts of any
length, linear but for a factor of the square root of the number of matches.

*Regex scan (D1).*  One regex pass marks every match with a private-use
character (``regexp_replace(text, rx, MARK$0MARK)``); splitting on the mark
gives ``[gap, match, gap, match, ..., gap]`` and one scan over the pieces gives
code-point offsets.  Texts that already hold the mark use the equivalent
``split(text, rx)`` + ``regexp_extract_all`` pair instead.

*Overlaps (O2).*  Rule ``j`` is checked against the spans kept by rules
``< j``: kept starts and candidate ends are merged in one sorted array, and a
scan carries the largest kept end that started before a candidate's end.  Spans
of an entity rule may overlap each other; a second scan in their order settles
that against what the same rule has kept so far.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import FEW, let, scan
from ..functions.text import is_blank, split_ws
from ..rules import Rule

# Up to so many matches of a rule in a text are taken one by one.
ALONE = 4
MARK = "\ue000"  # private-use code point used as a match delimiter
SPAN_T = "array<struct<s:int,e:int,k:int,v:string>>"


def _empty() -> Column:
    return F.array().cast(SPAN_T)


def overlaps(spans: Column, s: Column, e: Column) -> Column:
    """O1: half-open overlap of ``[s, e)`` with any span in ``spans``."""
    return F.exists(spans, lambda y: (y["s"] < e) & (y["e"] > s))


def passes_exclusions(v: Column, rule: Rule) -> Column:
    """Every word long enough and no word in the exclusion set."""
    def good(w: Column) -> Column:
        cond = F.lit(True)
        if rule.min_word_length > 1:
            cond = F.length(w) >= F.lit(rule.min_word_length)
        # IN over literals becomes a hash-set lookup (OptimizeIn -> InSet)
        return cond & ~w.isin(*rule.exclusions) if rule.exclusions else cond

    return F.forall(split_ws(v), good) if has_exclusions(rule) else F.lit(True)


def has_exclusions(rule: Rule) -> bool:
    return rule.min_word_length > 1 or bool(rule.exclusions)


def _pieces(text: Column, java: str) -> Column:
    native = F.split(F.regexp_replace(text, java, MARK + "$0" + MARK), MARK, -1)
    gaps = F.split(text, java, -1)
    found = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    alt = F.flatten(F.zip_with(gaps, found, lambda g, m: F.when(m.isNull(), F.array(g)).otherwise(F.array(g, m))))
    return F.when(F.instr(text, MARK) > 0, alt).otherwise(native)


def _offsets(pieces: Column, k: int) -> Column:
    """Odd pieces are matches; running code-point length gives their offsets."""
    state = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i"))

    def step(st, x):
        end = st["pos"] + F.length(x)
        hit = F.struct(st["pos"].alias("s"), end.alias("e"), F.lit(k).alias("k"), x.alias("v"))
        return (F.struct(end.alias("pos"), (st["i"] + 1).alias("i")),
                F.when(st["i"] % 2 == 1, F.array(hit)).otherwise(_empty()))

    def alone(p: Column, i: int) -> Column:
        """The match ``i`` of a few: its start is the length of the pieces before it."""
        s = F.length(F.get(p, F.lit(0)))
        for j in range(1, 2 * i + 1):
            s = s + F.length(F.get(p, F.lit(j)))
        v = F.get(p, F.lit(2 * i + 1))
        return F.struct(s.alias("s"), (s + F.length(v)).alias("e"), F.lit(k).alias("k"), v.alias("v"))

    def hits(p: Column) -> Column:
        n = F.size(p)
        out = F.when(n <= 1, _empty())
        for m in range(1, ALONE + 1):  # most texts have no more: no fold for them
            out = out.when(n == 2 * m + 1, F.array(*[alone(p, i) for i in range(m)]))
        return out.when(n > 2 * ALONE + 1, scan(p, state, SPAN_T, step)).otherwise(_empty())

    return let(pieces, hits)


def _python_scanner(rule: Rule, k: int):
    """Arrow fallback for patterns Java cannot run identically."""
    pattern, flags = rule.regex, rule.flags

    @F.pandas_udf(SPAN_T)
    def scan(texts: pd.Series) -> pd.Series:
        rx = re.compile(pattern, flags)
        out = []
        for t in texts:
            if t is None:
                out.append([])
                continue
            out.append([{"s": m.start(), "e": m.end(), "k": k, "v": m.group()} for m in rx.finditer(t)])
        return pd.Series(out)

    return scan


def regex_candidates(text: Column, rule: Rule, k: int) -> Column:
    """All matches of one rule that pass its exclusions, ordered by start."""
    if rule.native:
        raw = _offsets(_pieces(text, rule.java), k)
        if rule.literal:  # cheap pre-filter: skip the regex when a required character is absent
            raw = F.when(F.instr(text, rule.literal) > 0, raw).otherwise(_empty())
    else:
        raw = _python_scanner(rule, k)(text)
    return F.filter(raw, lambda x: passes_exclusions(x["v"], rule)) if has_exclusions(rule) else raw


def entity_candidates(text: Column, ents: Column, rule: Rule, k: int) -> Column:
    """Entities (``array<struct<s,e,label>>`` sorted by start) with a label
    of the rule, exclusions applied."""
    if not rule.labels:  # no label can match
        return _empty()
    picked = F.filter(F.coalesce(ents, F.array().cast("array<struct<s:int,e:int,label:string>>")),
                      lambda x: x["label"].isin(*rule.labels))
    spans = F.transform(picked, lambda x: F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(k).alias("k"),
        text.substr(x["s"] + 1, x["e"] - x["s"]).alias("v")))
    return F.filter(spans, lambda x: passes_exclusions(x["v"], rule))


def plan_detectors(rules: list[Rule], have_entities: bool, use_entities: bool = True) -> list[str]:
    """D3: per rule, 'entity' when entities are supplied and wanted, else
    'regex' when the rule has one, else 'none' (inert)."""
    kinds = []
    for r in rules:
        if r.entity and have_entities and use_entities:
            kinds.append("entity")
        elif r.regex is not None:
            kinds.append("regex")
        else:
            kinds.append("none")
    return kinds


def _free_of(kept: Column, cands: Column) -> Column:
    """Candidates that overlap no kept span: sorted by (place, kind), a kept span
    stands at its start, a candidate at its end, ahead of starts at that place."""
    kind = "array<struct<p:int,t:int,s:int,e:int,k:int,v:string>>"
    starts = F.transform(kept, lambda x: F.struct(x["s"].alias("p"), F.lit(1).alias("t"), x["s"].alias("s"), x["e"].alias("e"),
                                                  x["k"].alias("k"), F.lit("").alias("v")))
    ends = F.transform(cands, lambda x: F.struct(x["e"].alias("p"), F.lit(0).alias("t"), x["s"].alias("s"), x["e"].alias("e"),
                                                 x["k"].alias("k"), x["v"].alias("v")))

    def step(far, x):
        span = F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))
        return (F.when(x["t"] == 1, F.greatest(far, x["e"])).otherwise(far),
                F.when((x["t"] == 0) & (far <= x["s"]), F.array(span)).otherwise(_empty()))

    free = scan(F.sort_array(F.concat(starts, ends).cast(kind)), F.lit(0), SPAN_T, step)
    # few kept spans: look at each of them instead of sorting
    each = F.filter(cands, lambda x: ~overlaps(kept, x["s"], x["e"]))
    return F.when(F.size(cands) == 0, _empty()).when(F.size(kept) == 0, cands).when(F.size(kept) <= FEW, each).otherwise(free)


def _first_come(cands: Column) -> Column:
    """Of spans sorted by start, those that overlap none kept before them.
    ``near``: the largest kept end among spans starting where the last one did
    (an empty span does not overlap those)."""
    state = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("far"), F.lit(0).alias("near"))

    def step(st, x):
        moved = x["s"] > st["at"]
        far = F.when(moved, F.greatest(st["far"], st["near"])).otherwise(st["far"])
        near = F.when(moved, F.lit(0)).otherwise(st["near"])
        ok = (far <= x["s"]) & ((near <= x["s"]) | (x["e"] == x["s"]))
        return (F.struct(x["s"].alias("at"), far.alias("far"), F.when(ok, F.greatest(near, x["e"])).otherwise(near).alias("near")),
                F.when(ok, F.array(x)).otherwise(_empty()))

    return scan(cands, state, SPAN_T, step)


def _candidate_columns(units: DataFrame, rules: list[Rule], text_col: str, ents_col: str | None, use_entities: bool):
    """``units`` with one candidate array ``_c{k}`` per active rule."""
    text = F.col(text_col)
    kinds = plan_detectors(rules, ents_col is not None, use_entities)
    active = [k for k, kind in enumerate(kinds) if kind != "none"]
    cols = []
    for k in active:
        arr = entity_candidates(text, F.col(ents_col), rules[k], k) if kinds[k] == "entity" else regex_candidates(text, rules[k], k)
        cols.append(F.when(is_blank(text), _empty()).otherwise(arr).cast(SPAN_T).alias(f"_c{k}"))
    return units.select(*units.columns, *cols), active, kinds


def detect(units: DataFrame, rules: list[Rule], text_col: str = "_text", ents_col: str | None = None,
           use_entities: bool = True, out_col: str = "_spans") -> DataFrame:
    """Add ``out_col``: kept spans ``array<struct<s,e,k,v>>`` sorted by start.
    Each level is its own projection, so every regex is evaluated once."""
    df, active, kinds = _candidate_columns(units, rules, text_col, ents_col, use_entities)
    kept = F.col("_kept")
    df = df.withColumn("_kept", _empty())
    for k in active:
        cands = _free_of(kept, F.col(f"_c{k}"))
        if kinds[k] == "entity":
            cands = _first_come(F.sort_array(cands))
        df = df.withColumn("_kept", F.concat(kept, cands))
    return df.select(*units.columns, F.sort_array("_kept").alias(out_col))


def candidates_table(units: DataFrame, rules: list[Rule], key_cols: list[str], text_col: str = "_text") -> DataFrame:
    """Every candidate of every regex rule (before overlap resolution), one row
    per hit: ``key_cols, rule, k, s, e, v``."""
    names = F.array(*[F.lit(r.name) for r in rules])
    df, active, _ = _candidate_columns(units, rules, text_col, None, False)
    # explode_outer + filter: a plain explode makes the optimizer infer
    # size(...) > 0 and evaluate the whole span expression twice
    return (df.select(*key_cols, F.explode_outer(F.flatten(F.array(*[F.col(f"_c{k}") for k in active]))).alias("h"))
            .where(F.col("h").isNotNull())
            .select(*key_cols, F.element_at(names, F.col("h.k") + 1).alias("rule"), F.col("h.k").alias("k"),
                    F.col("h.s").alias("s"), F.col("h.e").alias("e"), F.col("h.v").alias("v")))
