"""Spelling variants: words one edit apart, by asymmetric q-chunks.

Of two words the longer one (of equal length: either) gives disjoint chunks, the
other its positional grams of the same sizes.  One inserted, deleted or replaced
character lies in one chunk, so the other chunk of the longer word is a gram of
the shorter one, shifted by at most one place.  A word is cut into two chunks at
its middle, and the half that holds the edit again into two: so a key is the
half that stays whole and the whole quarter of the other half (four keys a
word), which keeps the groups of a key small: they only differ within one
quarter.  Of the positional grams those are posted that can meet a chunk within
that shift: at its place for words of equal length, at its place or one to the
left for a word that is one shorter.  Words that meet are then verified.

Word counts come from all texts with map-side combining; everything after works
on the distinct words.  A key shared by many words is split by Spark's skew join.

Results: null texts have no words and a null id counts as the empty text;
repeated rows count again; an empty table gives no rows; other columns are not
looked at.  Ties between near words go to the smallest in code-point order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import written

RUN = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS, MIN_COUNT = 5, 3
#: one occurrence in so many loses a character (typing errors for the operator to find)
DAMAGE = 97


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE,
                min_chars: int = MIN_CHARS) -> DataFrame:
    """One row ``word`` for each run of letters of every text, lower-cased (A-Z
    only).  ``damage``: a run whose crc32 with the id is divisible by it loses
    one character."""
    # a run shorter than a word cannot become one; a longer one is matched from its start
    runs = F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(f"{RUN}{{{min_chars},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    word = F.col("run")
    if damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        rows = rows.select("run", h.alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= min_chars)


def _keys(word: Column, length: Column, shorter: bool) -> list[Column]:
    """The four keys of a word of ``length`` characters; with ``shorter`` those
    that a word one character shorter has in common with it."""
    half = F.floor(length / 2).cast("int")
    first, third = F.floor(half / 2).cast("int"), (half + F.floor((length - half) / 2)).cast("int")
    left = F.lit(1 if shorter else 0)  # behind the edit grams stand one to the left
    cut = lambda a, b: F.substring(word, a + 1, b - a)
    rest = lambda a: cut(a - left, length - left)
    zero = F.lit(0)
    return [rest(first), F.concat(cut(zero, first), rest(half)), F.concat(cut(zero, half), rest(third)), cut(zero, third)]


def _posted(words: DataFrame, shorter: bool) -> DataFrame:
    length = F.length("word") + (1 if shorter else 0)
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("part"), k.alias("key")) for i, k in enumerate(_keys(F.col("word"), length, shorter))])
    return words.select("word", "n", length.alias("len"), F.explode(keys).alias("k")).select("word", "n", "len", "k.part", "k.key")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs ``a, n_a, b, n_b`` of words (``word``, ``n``) one edit apart, each
    pair once."""
    chunks, on = _posted(words, False), ["len", "part", "key"]
    x = chunks.select(*on, F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = (chunks.select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(True).alias("same"))
             .unionByName(_posted(words, True).select(*on, F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(False).alias("same"))))
    met = x.join(grams, on).where(~F.col("same") | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").dropDuplicates(["a", "b"])


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form (``word, form``): forms
    followed to the last.  Each round doubles the steps taken; a form is at least
    twice as frequent as its word, so there are few rounds and no cycles."""
    cur = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(cur.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "spelling-roots")
        cur = new.drop("moved")
        if new.where("moved").isEmpty():
            return cur


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", damage: int | None = DAMAGE,
             min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per word that occurs ``min_count`` times or more: ``word``, ``n``,
    ``n_near`` (words one edit apart), ``form`` and ``form_n`` (its most frequent
    near word, if that is at least twice as frequent), ``root``."""
    found = occurrences(docs, id_col, text_col, damage, min_chars)
    words = written(found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count), "spelling-words")
    pairs = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = (pairs.select(ends.alias("e")).select("e.*").groupBy("word", "n")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near"))).alias("best")))
    large = -F.col("best.neg") >= 2 * F.col("n")
    best = written(best.select("word", "n_near", F.when(large, F.col("best.near")).alias("form"),
                               F.when(large, -F.col("best.neg")).alias("form_n")), "spelling-near")
    root = roots(best.where(F.col("form").isNotNull()))
    return (words.join(best, "word", "left").join(root, "word", "left")
            .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n",
                    F.coalesce("root", "word").alias("root")))
