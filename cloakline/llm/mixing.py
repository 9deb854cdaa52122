"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share of all words, stopped at ``max_copies`` times its
size, the excess reshared by weight.  With r = target / size every document of
the source gets floor(r) whole copies for certain; the rest of the target is
drawn: a document has the inclusion odds p / (1 - p) with p = r - floor(r), a
random number u from a digest of its id and text, and the ranking variable
q = (u / (1 - u)) / (p / (1 - p)).  Documents are taken in order of q until the
next would pass the rest; two more passes in that order take what still fits;
then the one document nearest the gap left is taken if that brings the source
nearer.  The sample's size is fixed in
words, not only in expectation, and depends on nothing but the rows.

No source is ever sorted in one task: its rows fall into buckets by q, and each
pass sums bucket totals (partial aggregates) over all rows still open and orders
only the bucket in which the gap is used up, about ``bucket_rows`` rows.  The
plan (one row a source) then gives every row its copies without a shuffle of the
texts.

Null text has size 0.  A null source is a source of its own, last in order.
Rows equal in id, text and source get equal numbers: they are taken together or
not at all.  An empty table gives no rows; sources of size 0 have target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakline.llm.common import packed, word_count, written

BUCKET_ROWS = 65_536
#: passes in order of q: the first takes whatever comes, later ones what still fits
ROUNDS = 3


def uniform(doc: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest; equal on every run."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")),
                      F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint") + 0.5) / float(1 << 52)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             seed: str = "mix", keep: bool = False) -> DataFrame:
    """Columns ``_id, _source, _size, _u`` of every row (with ``_all``, the whole row, if ``keep``)."""
    of = lambda c: F.col(f"_all.{c}")
    return packed(docs).select(*(["_all"] if keep else []), of(id_col).alias("_id"), of(source_col).alias("_source"),
                               word_count(of(text_col)).alias("_size"), uniform(of(id_col), of(text_col), seed).alias("_u"))


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """One row a source: its size, target, whole copies, inclusion probability
    and the words left to draw.  Sources by code point, null last, take the
    weights in turn.  (The windows order sources, not documents.)"""
    s = rows.groupBy("_source").agg(F.sum("_size").alias("s"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")).cast("bigint"))
    s = s.withColumn("cap", F.col("s") * max_copies)
    # by cap per weight: the sources that stop at their cap come first
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("_source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = (s.withColumn("left", F.sum("s").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
         .withColumn("rank", F.row_number().over(order))
         .withColumn("stops", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w")))
    free = F.min(F.when(~F.col("stops"), F.struct("rank", F.col("left").alias("l"), F.col("w_left").alias("wl")))).over(whole)
    s = s.withColumn("free", free).withColumn(
        "target", F.when(F.col("free").isNull() | (F.col("rank") < F.col("free.rank")), F.col("cap").cast("double"))
        .otherwise(F.col("w") * F.col("free.l") / F.col("free.wl")))
    ratio = F.coalesce(F.try_divide("target", "s"), F.lit(0.0))
    s = s.withColumn("sure", F.floor(ratio).cast("bigint")).withColumn("p", ratio - F.floor(ratio))
    return s.select("_source", F.col("s").alias("source_size"), "rows", "target", "sure", "p",
                    (F.col("target") - F.col("sure") * F.col("s")).alias("rest"))


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of sources with something to draw, with q."""
    both = rows.join(plan, rows["_source"].eqNullSafe(plan["_source"])).drop(plan["_source"])
    odds = F.col("p") / (1 - F.col("p"))
    return both.withColumn("q", F.try_divide(F.col("_u") / (1 - F.col("_u")), odds))


def _keyed(rows: DataFrame, plan: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows with something to draw, with their key and bucket.  Buckets part the
    numbers u, and so the order of q, evenly: each holds about ``bucket_rows``
    rows of its source."""
    buckets = F.greatest(F.ceil(F.col("rows") / bucket_rows), F.lit(1))
    return (_ranked(rows, plan).where("p > 0").withColumn("bucket", F.floor(F.col("_u") * buckets))
            .withColumn("key", F.struct("q", "_id", "_size")))


def _pass(rows: DataFrame, state: DataFrame, k: int, bucket_rows: int) -> DataFrame:
    """``state`` after pass k over all rows behind ``cut`` that fit ``gap``: bucket
    totals tell the bucket in which the gap is used up; only that one is ordered."""
    open_ = _keyed(rows, state, bucket_rows)
    if k:
        open_ = open_.where((F.col("cut").isNull() | (F.col("key") > F.col("cut"))) & (F.col("_size") <= F.col("gap")))
    sums = open_.groupBy("_source", "bucket").agg(F.sum("_size").alias("b"), F.max("key").alias("last"), F.max("gap").alias("gap"))
    sums = sums.withColumn("end", F.sum("b").over(Window.partitionBy("_source").orderBy("bucket")))
    whole = F.col("end") <= F.col("gap")
    at = sums.groupBy("_source").agg(F.min(F.when(~whole, F.col("bucket"))).alias("at"), F.coalesce(F.max(F.when(whole, F.col("end"))), F.lit(0)).alias("full"),
                                     F.max(F.when(whole, F.struct("bucket", "last")))["last"].alias("full_cut"))
    at = written(at, "mix-buckets")
    order = Window.partitionBy("_source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inner = (open_.select("_source", "bucket", "key", "_size", "gap").alias("r").join(at.alias("a"), F.expr("r._source <=> a._source AND r.bucket = a.at"))
             .select("r._source", "key", "_size", "gap", "full").withColumn("end", F.col("full") + F.sum("_size").over(order)))
    found = inner.where("end <= gap").groupBy("_source").agg(F.max("end").alias("end"), F.max("key").alias("key"))
    last = F.coalesce("i.key", "a.full_cut")
    return (state.alias("p").join(at.alias("a"), F.expr("p._source <=> a._source"), "left")
            .join(found.alias("i"), F.expr("p._source <=> i._source"), "left")
            .select(*[F.col(f"p.{c}") for c in state.columns if c not in ("cut", "gap")], last.alias(f"cut{k}"), F.col("p.gap").alias(f"gap{k}"),
                    (F.coalesce(last, F.col("p.cut")) if k else last).alias("cut"),
                    (F.col("p.gap") - F.coalesce("i.end", "a.full", F.lit(0))).alias("gap")))


def _drawn() -> Column:
    """Whether a row is taken by one of the passes."""
    key, out = F.struct("q", "_id", "_size"), F.lit(False)
    for k in range(ROUNDS):
        fits = F.col("_size") <= F.col(f"gap{k}") if k else F.lit(True)
        out |= F.coalesce((key <= F.col(f"cut{k}")) & fits, F.lit(False))
    return out


def cuts(rows: DataFrame, plan: DataFrame, n_rows: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The plan with, for each source, the last document drawn in order of q
    of each pass (``cut0``, then ``cut1`` ... among sizes up to ``gap1`` ...) and
    the one that fills the last gap (``fill``), as structs (q, id, size).  Buckets
    follow each source's own rows; ``n_rows``, those of the table, has no effect."""
    state = plan.withColumn("gap", F.col("rest"))
    for k in range(ROUNDS):
        state = written(_pass(rows, state, k, bucket_rows), "mix-pass")
    off = F.abs(F.col("gap") - F.col("_size"))
    found = (_keyed(rows, state, bucket_rows).where(~_drawn() & (off < F.col("gap")))
             .groupBy("_source").agg(F.min(F.struct(off.alias("d"), F.col("key").alias("k")))["k"].alias("fill")))
    return (state.alias("h").join(found.alias("i"), F.expr("h._source <=> i._source"), "left")
            .select("h._source", "source_size", "target", "sure", "p", "cut0", *[c for k in range(1, ROUNDS) for c in (f"cut{k}", f"gap{k}")], "fill"))


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with source_size, target and ``copies`` by a plan of ``cuts``."""
    ranked = _ranked(rows, plan)
    key = F.struct("q", "_id", "_size")
    drawn = _drawn() | F.coalesce(key == F.col("fill"), F.lit(False))
    return (ranked.withColumn("copies", F.col("sure") + (F.col("q").isNotNull() & drawn).cast("bigint"))
            .drop("sure", "p", "q", "cut0", "fill", *[f"{c}{k}" for k in range(1, ROUNDS) for c in ("cut", "gap")]))


def mix_plan(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """The finished plan, written (a row a source), so that nothing is planned twice."""
    return written(cuts(rows, written(targets(rows, weights, max_copies), "mix-targets")), "mix-plan")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, **columns) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them.  The rows are measured
    twice, once for the plan and once for the result, so that texts are neither
    shuffled nor written."""
    plan = mix_plan(written(measured(docs, **columns), "sizes"), weights, max_copies)
    taken = copies(measured(docs, keep=True, **columns), plan).where("copies > 0")
    return taken.select("_all", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_all.*")
