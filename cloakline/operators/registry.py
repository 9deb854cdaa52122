"""Pseudonym registry (R1-R11) as aggregation + window + join work.

The reference fills a dict value by value.  Here the same numbers come from:

* R1/R2  ``groupBy(scope, rule, key)`` with ``min(struct(first_pos, v, k))`` —
  partial aggregation collapses hot values map-side before the shuffle;
* R3     per-``(scope, rule)`` counter by first-seen position, either a plain
  window (many small scopes) or a two-phase ranged count (a scope of any size
  is spread over all tasks, see :func:`number_ranged`);
* R4/R5  templates rendered as ``format_string``/``lpad`` Columns;
* R6     equi-join of occurrences with the registry, hot keys salted;
* R7-R11 mapping, stats, collisions, incremental continuation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.templates import render
from ..functions.text import strip_ws
from ..rules import Rule
from ..session import checkpointed, partitions

# A value is hot when it has more occurrences than an even share of this many
# per task; its rows are then dealt over one salt per HOT_ROWS occurrences.
HOT_ROWS = 100_000


def rule_names(rules: list[Rule]) -> Column:
    return F.array(*[F.lit(r.name) for r in rules])


def occurrences(spanned: DataFrame, rules: list[Rule], spans_col: str = "_spans") -> DataFrame:
    """One row per kept span: ``_scope, _unit, s, e, k, v, rule, key, pos``.

    ``pos = (unit, k, s)`` is the reference's call order of ``get_or_create``."""
    h = F.col("h")
    # explode_outer + filter keeps the optimizer from re-deriving the spans
    # in an inferred size(...) > 0 filter pushed below the exchange
    ids = [c for c in ("_scope", "_unit", "_h") if c in spanned.columns]
    return (spanned.select(*ids, F.explode_outer(spans_col).alias("h")).where(h.isNotNull())
            .select(*ids, h["s"].alias("s"), h["e"].alias("e"), h["k"].alias("k"),
                    h["v"].alias("v"),
                    F.element_at(rule_names(rules), h["k"] + 1).alias("rule"),
                    strip_ws(h["v"]).alias("key"),
                    F.struct(F.col("_unit").alias("u"), h["k"].alias("k"), h["s"].alias("s")).alias("pos")))


def first_seen(occ: DataFrame) -> DataFrame:
    """Distinct ``(scope, rule, key)`` with the first occurrence."""
    agg = occ.groupBy("_scope", "rule", "key").agg(
        F.min(F.struct("pos", "v", "k")).alias("f"), F.count(F.lit(1)).alias("occurrences"))
    return agg.select("_scope", "rule", "key", F.col("f.pos").alias("first_pos"),
                      F.col("f.v").alias("first_v"), F.col("f.k").alias("first_k"), "occurrences")


def number_window(keys: DataFrame, offset: Column | None = None) -> DataFrame:
    w = Window.partitionBy("_scope", "rule").orderBy("first_pos", "key")
    n = F.row_number().over(w)
    return keys.withColumn("n", n if offset is None else n + offset)


def number_ranged(keys: DataFrame) -> DataFrame:
    """Two-phase numbering for scopes of any size.

    1. range-partition on ``(scope, rule, first_pos)`` and sort each
       partition, so ids grow with the first-seen order; the ranged frame is
       checkpointed so ids and partitions are fixed even if executors are lost;
    2. count rows per ``(scope, rule, partition)`` — at most groups + tasks
       rows — and prefix-sum those counts in a window;
    3. ``n = rows in earlier partitions + rank inside this partition``.
    """
    # no fixed count: AQE may merge adjacent ranges, which keeps them ordered
    ranged = (keys.repartitionByRange("_scope", "rule", "first_pos", "key")
              .sortWithinPartitions("_scope", "rule", "first_pos", "key")
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_gid", F.monotonically_increasing_id()))
    ranged = checkpointed(ranged)
    counts = ranged.groupBy("_scope", "rule", "_pid").agg(
        F.count(F.lit(1)).alias("_cnt"), F.min("_gid").alias("_g0"))
    w = Window.partitionBy("_scope", "rule").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    # offs has at most (scope, rule) groups + partitions rows; AQE broadcasts it
    # once its measured size is under the broadcast threshold, else shuffles.
    numbered = ranged.join(offs, ["_scope", "rule", "_pid"])
    return numbered.withColumn("n", F.col("_before") + F.col("_gid") - F.col("_g0") + 1).drop(
        "_pid", "_gid", "_cnt", "_g0", "_before")


def pseudonym_column(rules: list[Rule], n: Column, orig: Column, k: Column) -> Column:
    """Template of the rule block that registered the value."""
    expr = None
    for idx, r in enumerate(rules):
        val = render(r.template, n, orig)
        expr = F.when(k == idx, val) if expr is None else expr.when(k == idx, val)
    return expr


def build_registry(occ: DataFrame, rules: list[Rule], numbering: str = "ranged") -> DataFrame:
    """Registry rows: ``_scope, rule, key, n, pseudonym, first_pos, first_v,
    first_k, occurrences``.  ``ranged`` spreads scopes of any size over all
    tasks; ``window`` is for scopes that are one unit each."""
    numbered = number(first_seen(occ), numbering)
    return numbered.withColumn("pseudonym", pseudonym_column(rules, F.col("n"), F.col("first_v"), F.col("first_k")))


def hot_keys(counts: DataFrame, keys: list[str], n_col: str, total: int | None = None) -> DataFrame:
    """Keys of ``counts`` with more than ``max(HOT_ROWS, total / (8 x partitions))``
    rows, and their number of salts.  There are at most 8 x partitions of them,
    whatever the corpus, so the list may be broadcast."""
    parts = partitions(counts.sparkSession)
    total = total if total is not None else counts.agg(F.sum(n_col)).first()[0] or 0
    limit = max(HOT_ROWS, total // (8 * parts))
    salts = F.least(F.ceil(F.col(n_col) / F.lit(float(HOT_ROWS))), F.lit(64 * parts)).cast("int")
    return counts.where(F.col(n_col) > limit).select(*keys, salts.alias("_salts"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join ``big`` with ``small`` (one row per key) where the keys of
    ``hot`` (:func:`hot_keys`) are salted: their ``small`` row is repeated for
    every salt and each ``big`` row picks one by hashing its ``spread`` columns,
    so no task gets all rows of a hot key."""
    hot = F.broadcast(hot)
    big = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*spread), F.col("_salts"))).otherwise(F.lit(0)).cast("int"))
    small = (small.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1))
                                            .otherwise(F.array(F.lit(0))))))
    return big.drop("_salts").join(small.drop("_salts"), keys + ["_salt"], how).drop("_salt")


def attach_pseudonyms(occ: DataFrame, registry: DataFrame, unit: list[str]) -> DataFrame:
    """Occurrences joined with their pseudonym, hot values salted."""
    keys = ["_scope", "rule", "key"]
    hot = hot_keys(registry, keys, "occurrences")
    joined = salted_join(occ, registry.select(*keys, "pseudonym"), keys, hot, ["_unit", "s"])
    return joined.select(*unit, "s", "e", "k", "rule", "key", "pseudonym")


def mapping(registry: DataFrame) -> DataFrame:
    """``pseudonym -> stripped original``; when pseudonyms collide the value
    registered last wins; ``order`` is the pseudonym's first registration;
    ``occurrences`` how often it was written (a skew hint for restore)."""
    return registry.groupBy("_scope", "pseudonym").agg(
        F.max_by("key", "first_pos").alias("original"), F.min("first_pos").alias("order"),
        F.sum("occurrences").alias("occurrences"))


def stats(registry: DataFrame) -> DataFrame:
    """Distinct values per rule (the reference's counters)."""
    return registry.groupBy("_scope", "rule").agg(
        F.count(F.lit(1)).alias("count"), F.min("first_pos").alias("order"))


def stats_with_total(registry: DataFrame) -> DataFrame:
    """R8 with a total per scope (rollup)."""
    return (registry.rollup("_scope", "rule").agg(F.count(F.lit(1)).alias("count"),
                                                   F.grouping_id().alias("_g"))
            .where(F.col("_g") < 3).drop("_g"))


def collisions(registry: DataFrame) -> DataFrame:
    """Pseudonyms that stand for more than one (rule, value) key."""
    return (registry.groupBy("_scope", "pseudonym")
            .agg(F.count_distinct("rule", "key").alias("n_values"))
            .where(F.col("n_values") > 1))


def number(keys: DataFrame, numbering: str = "ranged") -> DataFrame:
    return number_window(keys) if numbering == "window" else number_ranged(keys)


@dataclass
class KeyedPrior:
    """An earlier registry that is asked for keys instead of read whole."""

    lookup: Callable[[DataFrame], DataFrame]  # (_scope, rule, key, ...) -> registry rows of these keys (others may come along)
    counters: DataFrame  # _scope, rule, _base: the largest number given so far


def continue_registry(old: DataFrame | KeyedPrior, occ: DataFrame, rules: list[Rule], numbering: str = "ranged") -> DataFrame:
    """Known values keep their number, new ones continue each counter.

    ``old`` is an earlier internal registry (columns of :func:`build_registry`) or
    a :class:`KeyedPrior`, then the result has the rows that it gives and the new
    ones; the new batch's first positions must sort after the old ones."""
    keys = ["_scope", "rule", "key"]
    seen = first_seen(occ)
    if isinstance(old, KeyedPrior):
        base, old = old.counters, old.lookup(seen)
    else:
        base = old.groupBy("_scope", "rule").agg(F.max("n").alias("_base"))
    fresh = number(seen.join(old.select(*keys), keys, "left_anti"), numbering).join(base, ["_scope", "rule"], "left")
    fresh = fresh.withColumn("n", F.col("n") + F.coalesce(F.col("_base"), F.lit(0))).drop("_base")
    fresh = fresh.withColumn("pseudonym", pseudonym_column(rules, F.col("n"), F.col("first_v"), F.col("first_k")))
    known = old.join(seen.select(*keys, F.col("occurrences").alias("_new")), keys, "left")
    known = known.withColumn("occurrences", F.col("occurrences") + F.coalesce(F.col("_new"), F.lit(0))).drop("_new")
    return known.unionByName(fresh.select(*old.columns))
