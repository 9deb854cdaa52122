"""Rewrite a Python ``re`` pattern into an equivalent Java pattern.

Spark's regex functions run ``java.util.regex`` inside whole-stage codegen.
Rules are written for Python ``re`` on ``str``, whose ``\\b \\w \\d \\s`` are
Unicode-aware, so the translation spells those classes out explicitly:

* ``\\w`` -> ``[\\p{L}\\p{N}_]``, ``\\d`` -> ``\\p{Nd}``, ``\\s`` -> Python's
  whitespace set; the negated forms as negated classes.
* ``\\b`` at the very start of a pattern in front of word-only characters
  becomes ``(?<!W)``; at the very end behind word-only characters ``(?!W)``;
  every other ``\\b`` the two-sided form (always right, a bit slower).
* ``(?P<n>..)``/``(?P=n)``/``\\Z``/``{,n}``/VERBOSE are rewritten to Java syntax.

Anything the translator does not understand raises :class:`Untranslatable`;
such a rule is scanned by the Arrow (pandas UDF) path with Python ``re``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .text import WORD, WORD_ASCII, WS, WS_ASCII


class Untranslatable(ValueError):
    """The pattern needs the Python-``re`` fallback scanner."""


_LOOKAROUND = ("(?=", "(?!", "(?<=", "(?<!")


@dataclass
class Node:
    kind: str  # lit | esc | cls | dot | anchor | group | backref
    text: str = ""
    prefix: str = ""  # group opener as written in Java
    alts: list = field(default_factory=list)  # group alternatives: list[list[Node]]
    qmin: int = 1
    quant: str = ""  # quantifier text already in Java form


def _is_word_char(ch: str) -> bool:
    return ch.isalnum() or ch == "_"


class _Parser:
    def __init__(self, pattern: str, verbose: bool):
        self.p = pattern
        self.i = 0
        self.verbose = verbose
        self.names: dict[str, str] = {}

    def parse(self) -> list[list[Node]]:
        alts = self._alternatives()
        if self.i != len(self.p):
            raise Untranslatable(f"unbalanced ')' at {self.i}")
        return alts

    def _alternatives(self) -> list[list[Node]]:
        alts: list[list[Node]] = [[]]
        while self.i < len(self.p):
            ch = self.p[self.i]
            if ch == ")":
                break
            if ch == "|":
                self.i += 1
                alts.append([])
                continue
            node = self._atom()
            if node is None:
                continue
            self._quantifier(node)
            alts[-1].append(node)
        return alts

    def _atom(self) -> Node | None:
        p, ch = self.p, self.p[self.i]
        if self.verbose and ch in " \t\n\r\f\v":
            self.i += 1
            return None
        if self.verbose and ch == "#":
            j = p.find("\n", self.i)
            self.i = len(p) if j < 0 else j + 1
            return None
        if ch == "(":
            return self._group()
        if ch == "[":
            return self._class()
        if ch == "\\":
            return self._escape()
        self.i += 1
        if ch == ".":
            return Node("dot", ".")
        if ch in "^$":
            return Node("anchor", ch)
        if ch in "*+?":
            raise Untranslatable("nothing to repeat")
        return _lit(ch)

    def _group(self) -> Node | None:
        p = self.p
        rest = p[self.i:]
        m = re.match(r"\(\?P<([A-Za-z_]\w*)>", rest)
        if m:
            java = f"g{len(self.names)}x{re.sub(r'[^A-Za-z0-9]', '', m.group(1))}"
            self.names[m.group(1)] = java
            prefix, self.i = f"(?<{java}>", self.i + m.end()
        elif rest.startswith("(?P="):
            m = re.match(r"\(\?P=([A-Za-z_]\w*)\)", rest)
            if not m or m.group(1) not in self.names:
                raise Untranslatable("bad named backreference")
            self.i += m.end()
            return Node("backref", f"\\k<{self.names[m.group(1)]}>")
        elif rest.startswith("(?#"):
            j = p.find(")", self.i)
            if j < 0:
                raise Untranslatable("unterminated comment")
            self.i = j + 1
            return None
        elif rest.startswith(("(?:", "(?=", "(?!", "(?>")):
            prefix, self.i = rest[:3], self.i + 3
        elif rest.startswith(("(?<=", "(?<!")):
            prefix, self.i = rest[:4], self.i + 4
        elif rest.startswith("(?"):
            m = re.match(r"\(\?([aiLmsux]*)(?:-([imsx]*))?([:)])", rest)
            if not m or "L" in m.group(1):
                raise Untranslatable(f"unsupported group {rest[:6]!r}")
            on = m.group(1)
            if "a" in on:
                raise Untranslatable("scoped ASCII flag")
            on = on.replace("u", "").replace("i", "iu")
            off = m.group(2) or ""
            if "x" in on + off:
                raise Untranslatable("scoped VERBOSE flag")
            spec = on + (f"-{off}" if off else "")
            self.i += m.end()
            if m.group(3) == ")":  # global inline flags, only valid at the start
                return Node("anchor", f"(?{spec})" if spec else "")
            prefix = f"(?{spec}:"
        else:
            prefix, self.i = "(", self.i + 1
        alts = self._alternatives()
        if self.i >= len(p) or p[self.i] != ")":
            raise Untranslatable("missing ')'")
        self.i += 1
        return Node("group", prefix=prefix, alts=alts)

    def _class(self) -> Node:
        p, j = self.p, self.i + 1
        out = ["["]
        if j < len(p) and p[j] == "^":
            out.append("^")
            j += 1
        first = True
        while True:
            if j >= len(p):
                raise Untranslatable("unterminated class")
            ch = p[j]
            if ch == "]" and not first:
                break
            first = False
            if ch == "\\":
                if j + 1 >= len(p):
                    raise Untranslatable("trailing backslash")
                out.append(_class_escape(p[j + 1]))
                j += 2
                continue
            if ch in "[&]":
                out.append("\\" + ch)
            else:
                out.append(ch)
            j += 1
        self.i = j + 1
        return Node("cls", "".join(out) + "]")

    def _escape(self) -> Node:
        p = self.p
        if self.i + 1 >= len(p):
            raise Untranslatable("trailing backslash")
        c = p[self.i + 1]
        self.i += 2
        if c in "dDwWsS":
            return Node("esc", "\\" + c)
        if c in "bB":
            return Node("anchor", "\\" + c)
        if c == "A":
            return Node("anchor", "\\A")
        if c == "Z":
            return Node("anchor", "\\z")
        if c.isdigit():
            if c == "0":
                return Node("esc", "\\x00")
            m = re.match(r"\d+", p[self.i - 1 :])
            self.i += len(m.group()) - 1
            return Node("backref", "\\" + m.group())
        if c == "U":
            hexd = p[self.i : self.i + 8]
            self.i += 8
            return Node("esc", f"\\x{{{hexd}}}")
        if c in "xu":
            n = 2 if c == "x" else 4
            hexd = p[self.i : self.i + n]
            self.i += n
            return Node("esc", f"\\{c}{hexd}")
        if c == "N":
            m = re.match(r"\{[^}]*\}", p[self.i :])
            if not m:
                raise Untranslatable("bad \\N escape")
            self.i += m.end()
            return Node("esc", "\\N" + m.group())
        if c in "tnrfva":
            return Node("esc", {"v": "\\x0b", "a": "\\x07"}.get(c, "\\" + c))
        if c.isalpha():
            raise Untranslatable(f"unknown escape \\{c}")
        return _lit(c)

    def _quantifier(self, node: Node) -> None:
        p = self.p
        if self.i >= len(p):
            return
        ch = p[self.i]
        if ch in "*+?":
            node.qmin = 0 if ch in "*?" else 1
            q = ch
            self.i += 1
        elif ch == "{":
            m = re.match(r"\{(\d*)(,?)(\d*)\}", p[self.i :])
            if not m or (not m.group(1) and not m.group(3)):
                return  # a literal brace, handled as the next atom
            lo, comma, hi = m.groups()
            node.qmin = int(lo or 0)
            q = "{" + (lo or "0") + comma + hi + "}"
            self.i += m.end()
        else:
            return
        if node.kind == "anchor":
            raise Untranslatable("quantified anchor")
        if self.i < len(p) and p[self.i] in "?+":
            q += p[self.i]
            self.i += 1
        node.quant = q


def _lit(ch: str) -> Node:
    java = "\\" + ch if ch in "\\^$.|?*+()[]{}" else ch
    return Node("lit", java, prefix=ch)


def _class_escape(c: str) -> str:
    return {"d": "\\d", "D": "\\D", "w": "\\w", "W": "\\W", "s": "\\s", "S": "\\S",
            "v": "\\x0b", "a": "\\x07", "b": "\\x08"}.get(c, "\\" + c)


# ── word-character analysis for \b ───────────────────────────────────────────

def _class_members_wordonly(cls_text: str) -> bool:
    body = cls_text[1:-1]
    if body.startswith("^"):
        return False
    j, chars = 0, []
    while j < len(body):
        if body[j] == "\\":
            e = body[j + 1]
            if e in "dw":
                chars.append(None)
            elif e in "DWsS":
                return False
            else:
                chars.append(e)
            j += 2
            continue
        chars.append(body[j])
        j += 1
    # resolve ranges a-z
    k, ok = 0, True
    while k < len(chars):
        c = chars[k]
        if c is None:
            k += 1
            continue
        if k + 2 < len(chars) and chars[k + 1] == "-" and chars[k + 2] is not None:
            lo, hi = ord(c), ord(chars[k + 2])
            if hi - lo > 5000:
                return False
            ok &= all(_is_word_char(chr(x)) for x in range(lo, hi + 1))
            k += 3
            continue
        ok &= _is_word_char(c)
        k += 1
    return ok


def _node_wordonly(node: Node, first: bool) -> bool:
    if node.kind == "lit":
        return _is_word_char(node.prefix)
    if node.kind == "esc":
        return node.text in ("\\d", "\\w")
    if node.kind == "cls":
        return _class_members_wordonly(node.text)
    if node.kind == "group" and not node.prefix.startswith(_LOOKAROUND):
        return all(_seq_edge_wordonly(a, first) for a in node.alts)
    return False


def _seq_edge_wordonly(seq: list[Node], first: bool) -> bool:
    """True when every first (or last) consumed character is a word character
    and at least one character is always consumed at that edge."""
    items = seq if first else list(reversed(seq))
    for node in items:
        if node.kind == "group" and node.prefix.startswith(_LOOKAROUND):
            continue
        if node.kind in ("anchor", "backref", "dot"):
            return False
        if not _node_wordonly(node, first):
            return False
        if node.qmin >= 1:
            return True
    return False


# ── emission ─────────────────────────────────────────────────────────────────

@dataclass
class JavaRegex:
    pattern: str
    ascii: bool
    literal: str | None = None


class _Emitter:
    def __init__(self, ascii_mode: bool):
        self.W = WORD_ASCII if ascii_mode else WORD
        self.S = WS_ASCII if ascii_mode else WS
        self.D = "0-9" if ascii_mode else "\\p{Nd}"

    def both_sided(self, negate: bool) -> str:
        w = self.W
        if negate:
            return f"(?:(?<=[{w}])(?=[{w}])|(?<![{w}])(?![{w}]))"
        return f"(?:(?<![{w}])(?=[{w}])|(?<=[{w}])(?![{w}]))"

    def esc(self, t: str) -> str:
        w, s, d = self.W, self.S, self.D
        return {"\\d": f"[{d}]", "\\D": f"[^{d}]", "\\w": f"[{w}]", "\\W": f"[^{w}]",
                "\\s": f"[{s}]", "\\S": f"[^{s}]"}.get(t, t)

    def cls(self, t: str) -> str:
        """A class, escape by escape: a backslash takes the next character with it."""
        w, s, d = self.W, self.S, self.D
        sets = {"\\d": d, "\\w": w, "\\s": s, "\\D": f"[^{d}]", "\\W": f"[^{w}]", "\\S": f"[^{s}]"}
        return re.sub(r"\\.", lambda m: sets.get(m.group(), m.group()), t, flags=re.DOTALL)

    def seq(self, seq: list[Node], top: bool) -> str:
        out = []
        lead = self._leading_boundary(seq) if top else None
        first, fixed = self._late_body(seq) if top and lead is None else (-1, -1)
        for idx, node in enumerate(seq):
            if lead is not None and idx == lead[0]:
                continue  # the leading \b, re-emitted after the first atom
            if lead is not None and idx == lead[1]:
                # \b X{m,n}  ->  X (?<!W X) X{m-1,n-1}: one cheap class test
                # per position instead of a look-behind at every position
                atom = self.node(node, seq, idx, top)
                w = self.W
                quant = self._quant(seq, idx)
                if lead[2]:
                    out.append(f"{atom}(?<![{w}]{atom})" + _less_one(atom, quant))
                else:  # class mixing word and other characters: split it
                    body = atom[1:-1]
                    aw, an = f"[{body}&&[{w}]]", f"[{body}&&[^{w}]]"
                    members = _ascii_members(node.text) or set()
                    words = {c for c in members if _is_word_char(c)}
                    # the look-behinds see the same character again: ASCII ones are spelled out, no intersection
                    w2, n2 = (_spelled(words), _spelled(members - words)) if words and words < members else (aw, an)
                    out.append(f"(?:{aw}(?<![{w}]{w2})|{n2}(?<=[{w}]{n2}))" + _less_one(atom, quant))
                continue
            if idx == first:
                # look-aheads scan the whole word: what is cheap to refuse goes first
                out.append("(?=" + "".join(self.node(n, seq, i, top) + n.quant for i, n in enumerate(seq) if i >= fixed) + ")")
            out.append(self.node(node, seq, idx, top) + self._quant(seq, idx))
        return "".join(out)

    def _quant(self, seq: list[Node], idx: int) -> str:
        """A greedy class in front of a character that it does not hold never gives a
        character back with success, so it need not try to (``[a-z]*+@``)."""
        node, after = seq[idx], seq[idx + 1] if idx + 1 < len(seq) else None
        if node.kind != "cls" or not node.quant or node.quant[-1] in "?+" and node.quant != "+" or after is None or after.kind != "lit" or after.qmin < 1:
            return node.quant
        members, ch = _ascii_members(node.text), after.prefix
        if after.text not in (ch, "\\" + ch) or members is None or ch in members or not ch.isascii() or ch.isalpha():  # letters: other cases may match
            return node.quant
        return node.quant + "+"

    def _late_body(self, seq: list[Node]) -> tuple[int, int]:
        """Places of the first look-ahead behind a leading boundary and of the body of
        fixed length behind the look-aheads; -1 for other sequences."""
        i = next((i for i, n in enumerate(seq) if not (n.kind == "anchor" and n.text.startswith("(?"))), len(seq))
        if i >= len(seq) or seq[i].kind != "anchor" or seq[i].text != "\\b":
            return -1, -1
        j = i + 1
        while j < len(seq) and seq[j].kind == "group" and seq[j].prefix.startswith(("(?=", "(?!")) and not seq[j].quant:
            j += 1
        fixed = [n.kind in ("lit", "esc", "cls") and re.fullmatch(r"(\{\d+\})?", n.quant) or n.kind == "anchor" and n.text == "\\b" for n in seq[j:]]
        return (i + 1, j) if j > i + 1 and fixed and all(fixed) else (-1, -1)

    def _leading_boundary(self, seq: list[Node]):
        i = 0
        while i < len(seq) and seq[i].kind == "anchor" and seq[i].text.startswith("(?"):
            i += 1
        if i >= len(seq) or seq[i].kind != "anchor" or seq[i].text != "\\b":
            return None
        j = i + 1
        while j < len(seq) and seq[j].kind == "group" and seq[j].prefix.startswith(("(?=", "(?!")):
            j += 1
        if j >= len(seq):
            return None
        atom = seq[j]
        if atom.kind in ("lit", "esc", "cls") and atom.qmin >= 1 and _node_wordonly(atom, True):
            # ahead of look-aheads the boundary stays where it is: it spares them inside words
            return (i, j, True) if j == i + 1 else None
        if atom.kind == "cls" and atom.qmin >= 1 and not atom.text.startswith("[^") and "[" not in atom.text[1:]:
            return (i, j, False)
        return None

    def node(self, node: Node, seq: list[Node], idx: int, top: bool) -> str:
        if node.kind in ("lit", "backref", "dot"):
            return node.text
        if node.kind == "esc":
            return self.esc(node.text)
        if node.kind == "cls":
            return self.cls(node.text)
        if node.kind == "group":
            return node.prefix + "|".join(self.seq(a, False) for a in node.alts) + ")"
        t = node.text
        if t == "\\B":
            return self.both_sided(True)
        if t != "\\b":
            return t
        if top:
            before = [n for n in seq[:idx] if not (n.kind == "anchor" and n.text.startswith("(?"))]
            after = seq[idx + 1 :]
            w = self.W
            if not before and _seq_edge_wordonly(after, True):
                return f"(?<![{w}])"
            if not after and _seq_edge_wordonly(seq[:idx], False):
                return f"(?![{w}])"
        return self.both_sided(False)


def _ascii_members(cls_text: str) -> set[str] | None:
    """The characters of a plain class (ASCII characters, ranges, escaped punctuation); None for others."""
    if not re.fullmatch(r"\[(?:[^\\\[\]^&~]|\\[^a-zA-Z0-9])+\]", cls_text) or not cls_text.isascii():
        return None
    rx = re.compile(cls_text)
    return {c for c in map(chr, range(128)) if rx.fullmatch(c)}


def _spelled(chars: set[str]) -> str:
    """A class of these ASCII characters, as ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "[" + "".join(f"\\x{a:02x}" if a == b else f"\\x{a:02x}-\\x{b:02x}" for a, b in ranges) + "]"


def _less_one(atom: str, quant: str) -> str:
    """``atom`` repeated one time fewer than ``quant`` says (``quant`` min >= 1)."""
    if quant == "":
        return ""
    mod = quant[-1] if len(quant) > 1 and quant[-1] in "?+" and not quant.startswith("{") or (
        quant.startswith("{") and quant[-1] in "?+") else ""
    core = quant[: len(quant) - len(mod)]
    if core == "+":
        return atom + "*" + mod
    m = re.fullmatch(r"\{(\d+)(,?)(\d*)\}", core)
    lo, comma, hi = int(m.group(1)), m.group(2), m.group(3)
    if not comma:
        return "" if lo == 1 else atom + "{" + str(lo - 1) + "}" + mod
    if hi:
        return atom + "{" + str(lo - 1) + "," + str(int(hi) - 1) + "}" + mod
    return atom + "{" + str(lo - 1) + ",}" + mod


def required_literal(pattern: str, flags: int = 0) -> str | None:
    """A character every match must contain (cheap ``instr`` pre-filter)."""
    try:
        tree = _Parser(re.sub(r"^\(\?[aiLmsux]+\)", "", pattern), bool(flags & re.VERBOSE)).parse()
    except Untranslatable:
        return None
    if len(tree) != 1 or flags & re.IGNORECASE or pattern.startswith("(?i"):
        return None
    for node in tree[0]:
        if node.kind == "lit" and node.qmin >= 1 and not node.prefix.isalnum():
            return node.prefix
    return None


def can_match_empty(pattern: str, flags: int = 0) -> bool:
    try:
        import re._parser as sre_parse  # Python 3.11+
    except ImportError:  # pragma: no cover
        import sre_parse  # type: ignore
    return sre_parse.parse(pattern, flags).getwidth()[0] == 0


_FLAG_BITS = {"IGNORECASE": re.IGNORECASE, "I": re.IGNORECASE, "MULTILINE": re.MULTILINE,
              "M": re.MULTILINE, "DOTALL": re.DOTALL, "S": re.DOTALL, "VERBOSE": re.VERBOSE,
              "X": re.VERBOSE, "ASCII": re.ASCII, "A": re.ASCII, "UNICODE": re.UNICODE,
              "U": re.UNICODE}


def python_flags(flag_names) -> int:
    flags = 0
    for name in flag_names or []:
        if name not in _FLAG_BITS:
            raise ValueError(f"unknown regex flag {name!r}")
        flags |= _FLAG_BITS[name]
    return flags


def to_java(pattern: str, flags: int = 0) -> JavaRegex:
    """Translate ``pattern`` (compiled with Python ``flags``) into Java syntax."""
    if can_match_empty(pattern, flags):
        raise Untranslatable("pattern can match the empty string")
    lead = re.match(r"\(\?([aiLmsux]+)\)", pattern)
    inline = lead.group(1) if lead else ""
    if lead:
        pattern = pattern[lead.end():]
    if "L" in inline or flags & re.LOCALE:
        raise Untranslatable("LOCALE flag")
    ascii_mode = bool(flags & re.ASCII) or "a" in inline
    verbose = bool(flags & re.VERBOSE) or "x" in inline
    tree = _Parser(pattern, verbose).parse()
    em = _Emitter(ascii_mode)
    if len(tree) == 1:
        body = em.seq(tree[0], True)
    else:
        body = "(?:" + "|".join(em.seq(a, False) for a in tree) + ")"
    jflags = "d"
    if flags & re.IGNORECASE or "i" in inline:
        jflags += "i" if ascii_mode else "iu"
    if flags & re.MULTILINE or "m" in inline:
        jflags += "m"
    if flags & re.DOTALL or "s" in inline:
        jflags += "s"
    return JavaRegex(f"(?{jflags}){body}", ascii_mode, required_literal(pattern, flags))
