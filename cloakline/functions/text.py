"""Column helpers that reproduce Python ``str`` whitespace and line semantics.

Spark's ``trim`` only strips U+0020 and Java's ``\\s`` is ASCII-only, while the
rule semantics follow Python's Unicode ``str.split`` / ``str.strip`` /
``str.splitlines``.  Everything here is a plain JVM-side Column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python treats as whitespace (str.isspace), as a
# Java character-class body.
WS = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Python's Unicode word characters (letters, numbers, underscore).
WORD = "\\p{L}\\p{N}_"
# ASCII variants used when a rule carries the ASCII flag.
WS_ASCII = "\\t-\\r\\x20"
WORD_ASCII = "a-zA-Z0-9_"

# Line boundaries of Python str.splitlines(), CRLF first.
LINE_BREAK = "\\r\\n|[\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()`` with no argument."""
    return F.regexp_replace(_col(c), f"^[{WS}]+|[{WS}]+$", "")


def split_ws(c) -> Column:
    """Python ``str.split()`` with no argument: whitespace runs, no empty words."""
    return F.filter(F.split(_col(c), f"[{WS}]+", -1), lambda w: w != F.lit(""))


def is_blank(c) -> Column:
    """``not text or not text.strip()``."""
    c = _col(c)
    return c.isNull() | ~c.rlike(f"[^{WS}]")


def splitlines(c) -> Column:
    """Python ``str.splitlines()`` as an array column (null text gives [])."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, n - 1)).otherwise(parts)
