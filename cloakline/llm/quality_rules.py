"""Quality rules with adaptive thresholds (DataFrame functions only).

Per text: counts of words, symbols, repeated lines and repeated 8-word windows.
A text fails the base rules outright (few words, much repetition).  The other
thresholds are not fixed: for each ratio a KLL quantile sketch is built per
language and source; the sketches are merged to languages and to the whole
table, and a document is held against the fence median + 4 x (q75 - q25) + slack
of its own group, or of its language, or of everything, whichever is the first
with ``MIN_GROUP`` documents.  (The slack is the least deviation worth a
rejection where a group hardly varies.)  A ratio beyond its fence rejects.

Null text counts as empty and so fails the base rules.  Null languages and
sources are groups like any other.  Only documents that pass the base rules
enter the sketches.  Repeated rows get equal verdicts; empty tables give none.
The sketches are of bounded size and merged from partial aggregates, so a group
with a third of all rows is no different from the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import NON_WS, WS, packed, written

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_GROUP = 200
SKETCH_K = 4096
#: ratio: (expression on the counts, slack, whether low values are rejected too)
RATIOS = {
    "symbols": ("try_divide(n_symbols, word_chars)", 0.03, False),
    "dup_lines": ("try_divide(n_dup_lines, n_lines)", 0.35, False),
    "upper": ("try_divide(n_upper, word_chars)", 0.25, False),
    "word_length": ("try_divide(word_chars, n_words)", 2.0, True),
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text."""
    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))

    def covered(at: Column) -> Column:  # at: ascending starts of repeated windows
        steps = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1),
                           lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(WINDOW), lambda s, x: s + x)

    def repeated(p: Column) -> Column:  # p: (hash, start), sorted: equal hashes are neighbours
        pairs = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1),
                           lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        return _let(F.sort_array(F.array_distinct(F.flatten(pairs))), covered)

    def count(w: Column) -> Column:
        some = F.size(F.array_distinct(w)) < F.size(w)
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(some, _let(F.sort_array(pairs), repeated)).otherwise(F.lit(0))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > WINDOW, _let(_let(hashes, windows), count)).otherwise(F.lit(0)).cast("bigint")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``_q`` of the counts and the base verdict."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("bigint")
    inner = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{WS}+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NON_WS))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n"), _repeat_words(w).alias("r"))

    by_word = _let(words, of_words)
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n"),
                                             (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("d")))
    out = docs.withColumn("_w", by_word).withColumn("_l", by_line)
    n, r = F.col("_w.n"), F.col("_w.r")
    counts = F.struct(
        n.alias("n_words"), (F.length(text) - rest(f"{NON_WS}+")).cast("bigint").alias("word_chars"),
        rest(f"[^{SYMBOLS}]+").alias("n_symbols"), F.col("_l.d").alias("n_dup_lines"), r.alias("n_repeat_words"),
        F.col("_l.n").alias("n_lines"), rest(r"\P{Lu}+").alias("n_upper"),
        ((n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)).alias("base_failed"))
    return out.withColumn("_q", counts).drop("_w", "_l")


def fences(rows: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Thresholds per (lang, source) as columns <ratio>_low and <ratio>_high."""
    names = list(RATIOS)
    base = (rows.where("NOT _q.base_failed").select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), "_q.*")
            .select("lang", "source", *[F.expr(f"cast({RATIOS[m][0]} as double)").alias(m) for m in names]))
    own = base.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in names])
    own = written(own, "quality-sketches")
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(m, F.lit(SKETCH_K)).alias(m) for m in names]]

    def quartiles(df: DataFrame, tag: str) -> DataFrame:
        q = lambda m, r: F.kll_sketch_get_quantile_double(m, F.lit(r))
        return df.select(*[c for c in ("lang", "source") if c in df.columns], F.struct(
            "n", *[F.array(q(m, 0.25), q(m, 0.5), q(m, 0.75)).alias(m) for m in names]).alias(tag))

    groups = own.select("lang", "source").alias("g")
    a = quartiles(own, "own").alias("a")
    b = quartiles(own.groupBy("lang").agg(*merged), "by_lang").alias("b")
    c = quartiles(own.agg(*merged).where("n > 0"), "every")
    table = (groups.join(a, F.expr("g.lang <=> a.lang AND g.source <=> a.source"))
             .join(b, F.expr("g.lang <=> b.lang")).join(c)  # one row: the whole table
             .select("g.lang", "g.source", "own", "by_lang", "every"))
    chosen = F.when(F.col("own.n") >= MIN_GROUP, F.col("own")).when(F.col("by_lang.n") >= MIN_GROUP, F.col("by_lang")).otherwise(F.col("every"))
    table = table.select("lang", "source", chosen.alias("t"))
    out = []
    for m in names:
        _, slack, low = RATIOS[m]
        q = F.col(f"t.{m}")
        reach = 4 * (q[2] - q[0]) + slack
        out += [(q[1] - reach if low else F.lit(None).cast("double")).alias(f"{m}_low"), (q[1] + reach).alias(f"{m}_high")]
    return written(table.select("lang", "source", *out), "quality-fences")


def judged(rows: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Add ``_kept``: passes the base rules and every fence of its group."""
    t = limits.select(F.struct("*").alias("_t"))
    both = rows.join(t, F.col(lang_col).eqNullSafe(F.col("_t.lang")) & F.col(source_col).eqNullSafe(F.col("_t.source")), "left")
    ok = ~F.col("_q.base_failed")
    for m, (expr, _, low) in RATIOS.items():
        for c in ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_upper", "n_words"):
            expr = expr.replace(c, f"_q.{c}")
        v = F.expr(f"cast({expr} as double)")
        ok &= v <= F.col(f"_t.{m}_high")
        if low:
            ok &= v >= F.col(f"_t.{m}_low")
    return both.withColumn("_kept", F.coalesce(ok, F.lit(False))).drop("_t")


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    rows = counted(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), "lang", "source"))
    rows = written(rows.drop("text"), "quality-counts")
    return judged(rows, fences(rows)).select(F.col("_id").alias("doc_id"), "_q.*", F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Whole rows of ``docs`` that pass."""
    rows = written(counted(packed(docs), f"_all.{text_col}"), "quality-rows")
    lang, source = f"_all.{lang_col}", f"_all.{source_col}"
    return judged(rows, fences(rows, lang, source), lang, source).where("_kept").select("_all.*")
