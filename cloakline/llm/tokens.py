"""Fast exact encoding with a public byte-level BPE file (``tokenizers`` library).

The pre-tokeniser of such files never joins a non-space character with the
blank after it, so a text can be cut before every blank that is followed by a
non-space character and the parts encoded alone: the ids of the whole text are
the ids of its parts in order.  Where the file has the plain byte-level
pre-tokeniser, texts are also cut on both sides of a line feed before a
non-space character (a token of its own) and between a letter and an ASCII
digit or sign, so that a word is the same part with and without a comma.

A group of texts is cut, its parts told apart and their ids put in order by
numpy and Arrow; only distinct parts become Python objects.  Parts repeat, so
each Python worker keeps the ids of short ones, up to ``CACHE_ENTRIES``; beyond
that bound the half not met for longest goes and is encoded again, with the
same result.  New parts are encoded many to one input: those with a blank have
one, their first character, so their ids begin at each id whose token starts
with one; those without are joined by line feeds.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_ENTRIES = 800_000
CACHE_CHARS = 48
#: texts are encoded in groups of about this many bytes (bounds memory)
GROUP_BYTES = 4_000_000
#: new words in one input of the tokenizer
JOINED_WORDS = 1_000
#: how byte-level vocabularies spell the blank and the line feed (fixed values)
BLANK = "\u0120"
LINE_FEED = "\u010a"

#: white space in UTF-8, as bytes and (the longer ones) as numbers, and for each byte: it starts no white space
SPACES = [c.encode() for c in map(chr, range(0x3100)) if c.isspace()]
SPACE_CODES = [int.from_bytes(x) for x in SPACES if len(x) > 1]
SOLID = np.array([b not in {x[0] for x in SPACES} for b in range(256)])

_ENCODERS: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fine = _plain_byte_level(self.tok)
        self.spelled = Tokenizer(self.tok.model)  # the same model, for words spelled as in the vocabulary
        self.spelled.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.starts = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.starts[[i for token, i in vocab.items() if token.startswith(BLANK)]] = True
        self.line_feed = vocab.get(LINE_FEED, -1)

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words that start with their only blank."""
        return self._joined_ids(words, lambda c: self._one("".join(c)), lambda ids: self.starts[ids])

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of a blank and ASCII letters, in the vocabulary's spelling."""
        spelled = lambda c: self._one("".join(c).replace(" ", " " + BLANK), self.spelled)
        return self._joined_ids(words, spelled, lambda ids: self.starts[ids])

    def _head_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words without a blank or a line feed."""
        if not self.fine:
            return self._ids(words)
        joined = self._joined_ids(words, lambda c: self._one("\n" + "\n".join(c)), lambda ids: ids == self.line_feed, 4)
        return [x[4:] for x in joined]

    def _one(self, text: str, tok=None) -> np.ndarray:
        e, = (tok or self.tok).encode_batch_fast([text], add_special_tokens=False)  # one at a time: its result is large
        return np.array(e.ids, dtype=np.uint32)

    def _joined_ids(self, words: list[str], encode, starts, skip: int = 0) -> list[bytes]:
        """Ids of each word with its mark, ``starts`` telling where they begin; ``skip``
        bytes stand for the mark where words have to be encoded one by one."""
        out: list[bytes] = []
        for i in range(0, len(words), JOINED_WORDS):
            chunk = words[i:i + JOINED_WORDS]
            ids = encode(chunk)
            at = (4 * np.flatnonzero(starts(ids))).tolist()
            if len(at) == len(chunk):
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
            else:  # a vocabulary of another kind
                out += [bytes(skip) + x for x in self._ids(chunk)]
        return out

    def _ids(self, parts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(parts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, kept ones or new."""
        ids = list(map(self.known.get, parts))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps and self.older:
            for i in gaps:
                ids[i] = self.older.get(parts[i])
            self.known.update((parts[i], ids[i]) for i in gaps if ids[i] is not None)
            gaps = [i for i in gaps if ids[i] is None]
        letters, words, heads, others = [], [], [], []
        for i in gaps:
            w = parts[i]
            blank = w.rfind(" ")
            if blank == 0 and len(w) > 1 and not w[1].isspace():
                (letters if self.fine and w.isascii() and w[1:].isalpha() else words).append(i)
            elif blank < 0 and "\n" not in w and not w[0].isspace():
                heads.append(i)
            else:
                others.append(i)
        for found, encode in ((letters, self._letter_ids), (words, self._word_ids), (heads, self._head_ids), (others, self._ids)):
            for i, x in zip(found, encode([parts[i] for i in found])):
                ids[i] = x
        self.known.update((parts[i], ids[i]) for i in gaps if len(parts[i]) <= CACHE_CHARS)
        if len(self.known) > CACHE_ENTRIES // 2:
            self.known, self.older = {}, self.known
        return ids

    def encode_array(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end``, and where each text's
        begin (one entry more than texts).  Null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
        chars = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        cuts = _cuts(chars, bounds, self.fine)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(chars)).dictionary_encode()
        ids = pa.array([*self._part_ids(parts.dictionary.to_numpy(zero_copy_only=False).tolist()), end], pa.large_binary())
        first = np.searchsorted(cuts, bounds)
        order = np.insert(parts.indices.to_numpy(), first[1:], len(ids) - 1)
        out = ids.take(pa.array(order))
        at = np.frombuffer(out.buffers()[1], dtype=np.int64)[first + np.arange(len(first))]
        return np.frombuffer(out.buffers()[2] or b"", dtype="<u4", count=at[-1] // 4), at // 4

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        ids, at = self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        at = at.tolist()
        return [ids[a:b].tobytes() for a, b in zip(at, at[1:])]


def _plain_byte_level(tok) -> bool:
    """Whether texts can be cut at line feeds and after letters too."""
    if tok.normalizer is not None or tok.pre_tokenizer is None or not all(t.special for t in tok.get_added_tokens_decoder().values()):
        return False
    kind = json.loads(tok.pre_tokenizer.__getstate__())
    return kind["type"] == "ByteLevel" and kind.get("use_regex", True) and not kind["add_prefix_space"]


def _cuts(chars: np.ndarray, bounds: np.ndarray, fine: bool) -> np.ndarray:
    """Where the parts of texts begin, and their end.  ``chars``: all texts in
    UTF-8, text i from ``bounds[i]`` on."""
    at = np.zeros(len(chars) + 1, dtype=bool)
    at[bounds] = True
    blanks = _before_solid(chars, at, np.flatnonzero(chars == 32))
    if fine:
        feeds = _before_solid(chars, at, np.flatnonzero(chars == 10))
        signs = np.flatnonzero((chars - np.uint8(33) < 94) & ~_letter(chars))  # ASCII digits and signs
        signs = signs[~at[signs]]
        x = chars[signs - 1]  # an ASCII letter, or the last byte of one from U+00C0 to U+00FF
        signs = signs[_letter(x) | ((chars[signs - 2] == 0xC3) & (x >= 0x80) & (x != 0x97) & (x != 0xB7))]
        at[feeds] = at[feeds + 1] = at[signs] = True
    at[blanks] = True
    return np.flatnonzero(at)


def _letter(chars: np.ndarray) -> np.ndarray:
    """ASCII letters among bytes (differences below zero count as large)."""
    return (chars | np.uint8(32)) - np.uint8(97) < 26


def _before_solid(chars: np.ndarray, at: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Those places after which a character follows in the same text that is no white space."""
    where = where[~at[where + 1]]
    c = chars[where + 1]
    ok = SOLID[c]
    doubt = np.flatnonzero(~ok & (c >= 0x80))  # bytes that start some white space and much else
    a = where[doubt] + 1
    two = chars[a].astype(np.int64) << 8 | chars[a + 1]
    ok[doubt] = ~np.isin(two, SPACE_CODES) & ~np.isin(two << 8 | chars[np.minimum(a + 2, len(chars) - 1)], SPACE_CODES)
    return where[ok]


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Give up this worker's encoders and what they keep, in a stage that encodes nothing."""
    _ENCODERS.clear()


def groups(batches: Iterator[pa.RecordBatch], limit: int = GROUP_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts (the first two columns) of successive rows, with about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
            total += n or 0
            if total >= limit:
                yield _columns([*held, batch.slice(start, i - start)])
                held, start, total = [], i, 0
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield _columns(held)


def ranges(texts: list[str | None], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters."""
    start = chars = 0
    for i, t in enumerate(texts, 1):
        chars += len(t or "")
        if chars >= limit:
            yield start, i
            start, chars = i, 0
    if start < len(texts):
        yield start, len(texts)


def _columns(batches: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return tuple(pa.concat_arrays([b.column(i) for b in batches]) for i in (0, 1))
