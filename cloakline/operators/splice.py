"""Splice (O3): replace kept spans by their pseudonyms, linear in the text.

Pieces ``text[prev_end:s] + pseudonym`` are built with one ``transform`` over
the start-sorted spans and joined once.  ``substring`` counts characters from the
start of its text, so with many spans the text is first cut into blocks of
``BLOCK`` characters and a piece is taken from the blocks that it touches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import FEW, let

BLOCK = 1024


def _spliced(repl: Column, between, rest) -> Column:
    """``between(a, b)`` and ``rest(a)`` give parts of the text."""
    def prev_end(i):
        return F.coalesce(F.get(repl, i - 1)["e"], F.lit(0))

    pieces = F.transform(repl, lambda x, i: F.concat(between(prev_end(i), x["s"]), x["pseudonym"]))
    return F.concat(F.array_join(pieces, ""), rest(F.get(repl, F.size(repl) - 1)["e"]))


def splice(text: Column, repl: Column) -> Column:
    """``repl``: ``array<struct<s,e,pseudonym>>`` sorted by ``s``; null or empty
    leaves the text as it is."""
    def in_blocks(blocks: Column) -> Column:
        block = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
        at = lambda a: F.floor(a / BLOCK).cast("int")
        inside = lambda a: F.pmod(a, F.lit(BLOCK))
        tail = lambda a: block(at(a)).substr(inside(a) + 1, F.lit(BLOCK))

        def between(a: Column, b: Column) -> Column:
            whole = F.array_join(F.slice(blocks, at(a) + 2, F.greatest(at(b) - at(a) - 1, F.lit(0))), "")
            return F.when(at(a) == at(b), block(at(a)).substr(inside(a) + 1, b - a)).otherwise(
                F.concat(tail(a), whole, block(at(b)).substr(F.lit(1), inside(b))))

        return _spliced(repl, between, lambda a: F.concat(tail(a), F.array_join(
            F.slice(blocks, at(a) + 2, F.greatest(F.size(blocks) - at(a) - 1, F.lit(0))), "")))

    short = _spliced(repl, lambda a, b: text.substr(a + 1, b - a), lambda a: text.substr(a + 1, F.length(text) + 1))
    long = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), in_blocks)
    return F.when(repl.isNull() | (F.size(repl) == 0), text).when(F.size(repl) <= FEW, short).otherwise(long)
