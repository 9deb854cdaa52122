"""SimHash near-duplicates by pigeonhole blocks.

A text's 64-bit fingerprint has the bits that are set in over half of its
shingles' XXH64 digests.  Fingerprints at most ``max_bits`` = 2 bits apart are
linked; groups are the connected components.  Equal fingerprints are one class
first, so copies never make pairs.

Blocks: 64 bits in four blocks of 16.  Two differing bits touch at most two
blocks, so a linked pair agrees in two whole blocks: each class is posted under
its six 32-bit block pairs, classes are joined on them, and the Hamming distance
is verified.  A bucket above ``BUCKET`` classes is not joined with itself: there
each class posts itself and its 32 one-bit changes outside the shared blocks.
Two fingerprints are at most 2 bits apart exactly if they post a common value,
and a value can be posted by 33 classes at most, so one link per class to the
smallest of the value's classes keeps every component, at linear cost.

Components: large-star / small-star rounds over the links, each written to the
shared folder, until nothing changes.

Null text counts as empty: fingerprint 0.  Texts without a word are linked with
each other as any others.  Repeated rows fall in one class.  A null id never
names a group if another id is there; a group of null ids only has a null name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import packed, python_ready, written

#: classes in a block bucket up to which they are joined with each other
BUCKET = 64
_BLOCK = 16
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
#: bits of every byte value, as floats for a product with counts
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII blanks only
    if not w:
        return 0
    parts = zip(*(w[i:] for i in range(shingle))) if len(w) >= shingle else [w]
    h = np.array([xxh64_intdigest(b" ".join(p), seed) for p in parts], dtype="<u8")
    by_byte = h.view(np.uint8).reshape(-1, 8)
    fp = 0
    for i in range(8):
        ones = np.bincount(by_byte[:, i], minlength=256) @ _BITS
        fp |= int(np.packbits(2 * ones > len(h), bitorder="little")[0]) << (8 * i)
    return fp - (1 << 64) if fp >= 1 << 63 else fp


def fingerprint(text: Column, shingle: int = 3) -> Column:
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return of(text)


def _mask(pair: tuple[int, int]) -> int:
    m = sum(((1 << _BLOCK) - 1) << (_BLOCK * b) for b in pair)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(classes: DataFrame) -> DataFrame:
    """Links (a < b) between distinct fingerprints in column ``fp``; within a
    large bucket only those needed to keep its components."""
    posts = classes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_mask(p)).cast("bigint")).alias("v"))
        for k, p in enumerate(_PAIRS)])).alias("b")).select("fp", "b.k", "b.v")
    sizes = posts.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(posts.join(sizes, ["k", "v"]), "simhash-blocks")

    few = shared.where(F.col("n") <= BUCKET)
    a, b = few.select("k", "v", F.col("fp").alias("a")), few.select("k", "v", F.col("fp").alias("b"))
    near = a.join(b, ["k", "v"]).where("a < b AND bit_count(a ^ b) <= 2").select("a", "b")

    bit = [1 << i for i in range(63)] + [-(1 << 63)]
    outside = [[F.lit(0)] + [F.lit(bit[i]) for i in range(64) if i // _BLOCK not in p] for p in _PAIRS]
    flips = reduce(lambda c, k: c.when(F.col("k") == k, F.array(*[x.cast("bigint") for x in outside[k]])),
                   range(1, len(_PAIRS)), F.when(F.col("k") == 0, F.array(*[x.cast("bigint") for x in outside[0]])))
    many = shared.where(F.col("n") > BUCKET).select("k", "fp", F.explode(flips).alias("flip"))
    stars = (many.groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
             .agg(F.collect_list("fp").alias("fps"))  # 33 at most
             .where("size(fps) > 1")
             .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
             .where("a < b AND bit_count(a ^ b) <= 2"))
    return near.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b); root is the smallest node
    of the component."""
    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    state = None
    while True:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        cur = written(small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .union(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "small-star")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    stars = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root")).distinct()


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                      keep: bool = False) -> DataFrame:
    """Written table ``_id, _fp, _row`` (with ``_all``, the whole row, if ``keep``)."""
    python_ready(docs.sparkSession)
    rows = packed(docs).select(*(["_all"] if keep else []), F.col(f"_all.{id_col}").cast("bigint").alias("_id"),
                               fingerprint(F.col(f"_all.{text_col}"), shingle).alias("_fp"))
    return written(rows.withColumn("_row", F.monotonically_increasing_id()), "fingerprints")


def groups(rows: DataFrame) -> DataFrame:
    """(_fp, component_id) for the distinct fingerprints of ``with_fingerprints``."""
    classes = written(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("least")), "classes")
    comps = components(links(classes))
    rooted = (classes.join(comps, classes["fp"] == comps["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(names, "root").select(F.col("fp").alias("_fp"), "component_id")


def near_duplicate_groups(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = with_fingerprints(docs, **columns)
    return (rows.join(groups(rows), "_fp")
            .select(F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, **columns) -> DataFrame:
    """Whole rows of ``docs``, one per component: the smallest id's (of repeated
    ids, the first row read)."""
    rows = with_fingerprints(docs, keep=True, **columns)
    best = (rows.select("_fp", "_id", "_row").join(groups(rows), "_fp")
            .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("_fp")).alias("_none"))
            .agg(F.min(F.struct(F.coalesce("_id", F.lit((1 << 63) - 1)).alias("i"), F.col("_row").alias("r")))["r"].alias("_row")))
    return rows.join(best.select("_row"), "_row", "left_semi").select("_all.*")
