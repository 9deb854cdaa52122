"""Pseudonym templates compiled to Column expressions.

A template is a Python format string over ``n`` (the per-rule counter),
``orig`` (the first-seen original text) and ``orig_len`` (its length), or the
keyword ``preserve_length`` (the counter zero-padded to the original's width,
never truncated).  Common specs become ``format_string``; anything else is
rendered with Python's ``str.format`` in an Arrow UDF over the registry (one
row per distinct value, never per occurrence).
"""

from __future__ import annotations

import re
import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRESERVE_LENGTH = "preserve_length"

_SPEC = re.compile(
    r"^(?:(?P<fill>.)?(?P<align>[<>^=]))?(?P<sign>[+\- ])?(?P<zero>0)?(?P<width>\d+)?"
    r"(?P<group>,)?(?:\.(?P<prec>\d+))?(?P<type>[dxXos])?$"
)


class NeedsPython(ValueError):
    """Template spec outside the native subset."""


def _java_spec(field: str, spec: str) -> str:
    m = _SPEC.match(spec)
    if not m:
        raise NeedsPython(spec)
    d = m.groupdict()
    numeric = field in ("n", "orig_len")
    typ = d["type"] or ("d" if numeric else "s")
    if numeric and typ == "s" or not numeric and typ != "s":
        raise NeedsPython(spec)
    if d["fill"] not in (None, " ") and not (d["fill"] == "0" and d["align"] == "="):
        raise NeedsPython(spec)
    if d["align"] in ("^",) or (d["align"] == "=" and not numeric):
        raise NeedsPython(spec)
    flags = ""
    if d["sign"] == "+":
        flags += "+"
    elif d["sign"] == " ":
        flags += " "
    if d["group"]:
        if typ != "d":
            raise NeedsPython(spec)
        flags += ","
    left = d["align"] == "<" or (d["align"] is None and not numeric)
    if d["zero"] or (d["fill"] == "0" and d["align"] == "="):
        if not numeric or d["align"] == "<":
            raise NeedsPython(spec)
        flags += "0"
    elif left and d["width"]:
        flags += "-"
    if not numeric and d["prec"]:
        prec = "." + d["prec"]
    elif d["prec"]:
        raise NeedsPython(spec)
    else:
        prec = ""
    return "%" + flags + (d["width"] or "") + prec + typ


def compile_template(template: str):
    """Return ``(fmt, fields)`` for ``format_string`` or raise :class:`NeedsPython`."""
    fmt, fields = [], []
    for literal, name, spec, conv in string.Formatter().parse(template):
        fmt.append(literal.replace("%", "%%"))
        if name is None:
            continue
        if name not in ("n", "orig", "orig_len") or conv:
            raise NeedsPython(template)
        fmt.append(_java_spec(name, spec or ""))
        fields.append(name)
    return "".join(fmt), fields


def is_native(template: str) -> bool:
    """Does :func:`render` give built-in functions only?"""
    if template == PRESERVE_LENGTH:
        return True
    try:
        compile_template(template)
    except NeedsPython:
        return False
    return True


@F.pandas_udf(T.StringType())
def _python_format(template: pd.Series, n: pd.Series, orig: pd.Series) -> pd.Series:
    return pd.Series(
        [t.format(n=int(k), orig=o, orig_len=len(o)) for t, k, o in zip(template, n, orig)]
    )


def render(template: str, n: Column, orig: Column) -> Column:
    """Pseudonym Column for ``template`` given counter ``n`` and original ``orig``."""
    if template == PRESERVE_LENGTH:
        ns = n.cast("string")
        return F.lpad(ns, F.greatest(F.length(orig), F.length(ns)), "0")
    try:
        fmt, fields = compile_template(template)
    except NeedsPython:
        return _python_format(F.lit(template), n, orig)
    args = {"n": n.cast("long"), "orig": orig, "orig_len": F.length(orig)}
    if not fields:
        return F.lit(fmt.replace("%%", "%"))
    return F.format_string(fmt, *[args[f] for f in fields])
