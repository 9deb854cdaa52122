"""Sequential scans over long arrays as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


FEW = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def scan(arr: Column, state: Column, out_t: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Fold with output: ``step(state, x) -> (new state, array of outputs)``;
    the result is all outputs in order (``out_t``: their array type).

    An ``aggregate`` that appends to one growing array copies it at every
    element.  Here the elements go in chunks of about the square root of their
    number, each with an output array of its own, so n elements cost n ** 1.5
    reference copies instead of n ** 2."""

    def chunked(a: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(a))).cast("int")

        def one(acc: Column, x: Column) -> Column:
            new, out = step(acc["st"], x)
            return F.struct(new.alias("st"), F.concat(acc["out"], out).alias("out"))

        def chunk(acc: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(a, i, size), F.struct(acc["st"].alias("st"), F.array().cast(out_t).alias("out")), one)
            return let(inner, lambda r: F.struct(r["st"].alias("st"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

        start = F.struct(state.alias("st"), F.array().cast(f"array<{out_t}>").alias("outs"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(a), size), start, chunk, lambda acc: acc["outs"]))

    def direct(a: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            new, out = step(acc["st"], x)
            return F.struct(new.alias("st"), F.concat(acc["out"], out).alias("out"))

        return F.aggregate(a, F.struct(state.alias("st"), F.array().cast(out_t).alias("out")), one, lambda acc: acc["out"])

    # few elements: one chunk, the same steps without the outer fold
    return let(arr, lambda a: F.when(F.size(a) <= FEW, direct(a)).otherwise(chunked(a)))
