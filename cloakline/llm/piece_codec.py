"""Exact SentencePiece-BPE encoding by a prefix table, and decoding.

Of a text's prefix only one piece can be the last piece of its encoding.  So a
table with one entry a position describes the encodings of all prefixes: an
automaton reports the pieces that end at a position, and the one that fits
behind the last piece of the prefix before it is the entry.  Two pieces fit if
merging their joined text from single characters (best score first, leftmost
among equal scores) never merges across the seam; answers are kept.  The ids are
then read backwards.  The work grows with the length of the text, whatever it
holds, so texts without blanks cost no more than others.  A character without a
piece never merges; it becomes its UTF-8 byte pieces.

No piece of such a model goes on behind a blank or holds a line feed (checked
when it is loaded), so a text is cut there and short parts, which repeat, are
looked up; ``CACHE_PARTS`` bounds what a worker keeps, beyond it the least
recently met half goes and is computed again when needed.

Results: null text counts as empty and has the end id alone; repeated rows and
null ids give one row each; an empty table gives none; columns other than the id
and the text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import python_ready
from cloakline.llm.tokens import ranges

CACHE_PARTS = 1_000_000
CACHE_CHARS = 48
#: what SentencePiece writes for a blank
BLANK = "▁"

_CODECS: dict[str, "Codec"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Pieces of a BPE model with byte fallback, no normalisation rules and a
    blank put before the text (other kinds are refused)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.lib.get_piece_size()
        kind = [(self.lib.is_control(i) or self.lib.is_unknown(i), self.lib.is_byte(i)) for i in range(size)]
        piece = [self.lib.id_to_piece(i) for i in range(size)]
        self.piece = piece
        self.ids = {piece[i]: i for i in range(size) if kind[i] == (False, False)}
        self.score = {p: self.lib.get_score(i) for p, i in self.ids.items()}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(kind[i][1] for i in self.byte):
            raise ValueError("the model has no byte pieces")
        if self.lib.normalize(" ﬁ  A ") != f"{BLANK}{BLANK}ﬁ{BLANK}{BLANK}A{BLANK}":
            raise ValueError("the model changes texts before it encodes them")
        if any(re.search(f"[^{BLANK}]{BLANK}|\n", p) for p in self.ids):
            raise ValueError("a piece goes on behind a blank or a line feed")
        self.pairs: dict[int, bool] = {}
        #: neighbours inside some piece; between others no merge can happen
        self.inside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}
        self.history: list[list[tuple[float, str, str]]] = [[] for _ in range(size)]
        self.auto = ahocorasick.Automaton()
        for p, i in self.ids.items():
            whole, self.history[i] = self.merges(p)
            if whole:  # others never stand in an encoding
                self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()

    def merges(self, text: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """The rule itself for the text of a piece: merge the best pair until
        none is a piece.  Is it one piece then, and after each merge: its score,
        the first part and the last part."""
        parts, steps = list(text), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))
        return len(parts) == 1, steps

    def fits(self, a: int, b: int) -> bool:
        """May piece ``b`` follow piece ``a`` in an encoding?  Both come about as
        if alone, the better merge first (the left one among equals), unless at
        some time the parts beside the seam are the best pair."""
        score, left, right = self.score, self.history[a], self.history[b]
        end, start = self.piece[a], self.piece[b]
        if end + start in score:
            return False
        end, start, i, j = end[-1], start[0], 0, 0
        while i < len(left) or j < len(right):
            seam = score.get(end + start)
            if i < len(left) and (j == len(right) or left[i][0] >= right[j][0]):
                if seam is not None and seam > left[i][0]:
                    return False
                end, i = left[i][2], i + 1
            else:
                if seam is not None and seam >= right[j][0]:
                    return False
                start, j = right[j][1], j + 1
        return True

    def part_ids(self, text: str) -> tuple[int, ...]:
        """Ids of a text with blanks written as ``BLANK``: of its runs between
        characters that stand side by side in no piece."""
        inside, out, start = self.inside, [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1:k + 1] not in inside:
                run = text[start:k]
                ids = self.runs.get(run)
                if ids is None:
                    ids = self.run_ids(run)
                    if k - start <= CACHE_CHARS:
                        self.runs[run] = ids
                out.append(ids)
                start = k
        if len(self.runs) > CACHE_PARTS // 2:
            self.runs = {}
        return tuple(chain.from_iterable(out))

    def run_ids(self, text: str) -> tuple[int, ...]:
        """The prefix table of a run and its ids."""
        last = [-1] * (len(text) + 1)  # last piece of each prefix, -1: a character without piece (or no text)
        size = last[:]
        pairs = self.pairs
        for end, (i, n) in self.auto.iter(text):
            end += 1
            if size[end] > 0:
                continue
            before = last[end - n]
            if before >= 0:
                ok = pairs.get(before << 20 | i)
                if ok is None:
                    ok = pairs[before << 20 | i] = self.fits(before, i)
                if not ok:
                    continue
            last[end], size[end] = i, n
        out: list[int] = []
        at = len(text)
        while at > 0:
            if last[at] < 0:
                out.extend(self.byte[b] for b in reversed(text[at - 1].encode("utf-8", "surrogatepass")))
                at -= 1
            else:
                out.append(last[at])
                at -= size[at]
        return tuple(reversed(out))

    def _lookup(self, parts: list[str]) -> list[tuple[int, ...]]:
        found = list(map(self.known.get, parts))
        if None in found:
            for at, ids in enumerate(found):
                if ids is None:
                    p = parts[at]
                    ids = self.known.get(p) or self.older.get(p)
                    if ids is None:
                        ids = self.part_ids(p if p[:1] == "\n" else BLANK + p.replace(" ", BLANK))
                    if len(p) <= CACHE_CHARS:
                        self.known[p] = ids
                    found[at] = ids
            if len(self.known) > CACHE_PARTS // 2:
                self.known, self.older = {}, self.known
            if len(self.pairs) > 4 * CACHE_PARTS:
                self.pairs = {}
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        if not text:
            return []
        parts = text.replace(BLANK, " ").replace("\n", " \n").split(" ")
        if "" in parts:
            parts = _with_runs(text.replace(BLANK, " "))
        return list(chain.from_iterable(self._lookup(parts)))

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1) if ids else []


def _with_runs(text: str) -> list[str]:
    """Parts of a text with runs of blanks: a part is a run of blanks but the
    first and what follows it, or a line feed and what follows that."""
    return [p[1:] if p[0] == " " else p for p in re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text)]


def codec(path: str) -> Codec:
    """One codec per Python worker and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_decode(docs: DataFrame, model: str | None = None, end_id: int = 2, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, ``ids`` (with the end id) and
    ``decoded``, the text that decoding these ids gives."""
    python_ready(docs.sparkSession)
    path = model or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in ranges(texts):
                ids = [[*c.encode(t or ""), end_id] for t in texts[a:b]]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1])))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(c.decode(ids), pa.string())],
                    names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
