"""Quality classifier: nearest-neighbour voting among labelled latent vectors.

Terms of a text: character trigrams (lower case, hashed), trigrams of character
classes (lower, upper, digit, blank, line end, other marks by themselves), and
bucketed facts of the whole text (share of distinct words, of repeated lines, of
marks and capitals, word length, size).  Counts are damped by log(1 + n), scaled
by inverse document frequency and normalised per family; a truncated singular
value decomposition of the labelled sample gives the latent space.  Labelled
vectors are broadcast; each document's vector is multiplied with all of them
exactly, block by block, and the ``NEIGHBOURS`` most similar vote with their
cosine to the power ``POWER``.

The labelled sample is about ``MAX_LABELLED`` rows chosen by a hash of id and
text, so the model's size is bounded; every text is scored whole.  Null text
counts as empty.  Labels that are null teach nothing; without any label every
score is ``PRIOR``.  A label row repeated for one document counts once (the
largest label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import python_ready
from cloakline.llm.tokens import ranges

MAX_LABELLED = 3000
LATENT = 64
NEIGHBOURS = 25
POWER = 8
THRESHOLD = 0.3
PRIOR = 0.5
BLOCK = 256
_GRAMS, _SHAPES, _BUCKETS = 2048, 1024, 12
_FACTS = 6
WIDTH = _GRAMS + _SHAPES + _FACTS * _BUCKETS
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of every code point: marks stand for themselves."""
    if not _CLASSES:
        c = np.full(0x110000, 1, dtype=np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isupper():
                c[i] = 2
            elif ch.isdigit():
                c[i] = 3
            elif i < 128 and not ch.isalnum():
                c[i] = 8 + i
        _CLASSES.append(c)
    return _CLASSES[0]


def _facts(text: str, upper: int, marks: int) -> list[int]:
    w = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(w), max(1, len(text))
    shares = (len(set(w)) / n ** 0.85 if n else 1.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, marks / chars, upper / chars)
    top = _BUCKETS - 1
    return [*(min(top, int(_BUCKETS * s ** 0.7)) for s in shares),
            min(top, int(sum(map(len, w)) / n)) if n else 0, min(top, int(np.log2(n + 1)))]


def term_counts(texts: list[str]) -> np.ndarray:
    """Text x term matrix, damped, every family of a text at length 1."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    low_parts = [t.lower() for t in texts]
    for low, raw, base, size in ((low_parts, False, 0, _GRAMS), (texts, True, _GRAMS, _SHAPES)):
        n = np.array([len(t) for t in low])
        cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        if raw:
            cp = _classes()[cp]
            doc = np.repeat(np.arange(len(texts)), n)
            upper = np.bincount(doc[cp == 2], minlength=len(texts))
            marks = np.bincount(doc[(cp >= 8) & (cp != 40) & (cp != 18)], minlength=len(texts))
        if len(cp) > 2:
            doc = np.repeat(np.arange(len(texts)), n)
            h = (cp[:-2].astype(np.uint64) * np.uint64(0x9E3779B1) + cp[1:-1]) * np.uint64(0x85EBCA77) + cp[2:]
            h = (h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
            inside = doc[:-2] == doc[2:]
            cells = (doc[:-2] * size + (h % np.uint64(size)).astype(np.int64))[inside]
            out[:, base:base + size] = np.log1p(np.bincount(cells, minlength=len(texts) * size).reshape(len(texts), size))
    rows = np.arange(len(texts))
    at = np.array([_facts(t, int(u), int(m)) for t, u, m in zip(texts, upper, marks)]).reshape(len(texts), _FACTS)
    for k in range(_FACTS):
        out[rows, _GRAMS + _SHAPES + k * _BUCKETS + at[:, k]] = 1
    return out


_FAMILIES = ((0, _GRAMS, 0.5), (_GRAMS, _GRAMS + _SHAPES, 1.0), (_GRAMS + _SHAPES, WIDTH, 1.5))


def _weigh(x: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = x * idf
    for a, b, weight in _FAMILIES:
        length = np.linalg.norm(x[:, a:b], axis=1, keepdims=True)
        x[:, a:b] *= weight / np.where(length > 0, length, 1)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # term x latent
    vectors: np.ndarray  # labelled x latent, length 1
    labels: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        z = _unit(_weigh(term_counts(texts), self.idf) @ self.basis)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(texts), BLOCK):
            s = z[a:a + BLOCK] @ self.vectors.T
            near = np.argpartition(-s, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(s, near, 1), 0).astype(np.float64) ** POWER
            total = w.sum(axis=1)
            out[a:a + BLOCK] = np.where(total > 0, (w * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Latent space and vectors of labelled rows (damped counts, labels)."""
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    w = _weigh(x, idf)
    # randomised range finder with two power steps, then an exact SVD of the small matrix
    q = w @ np.random.default_rng(7).standard_normal((w.shape[1], LATENT + 16)).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(w @ (w.T @ q))
    q, _ = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(q.T @ w, full_matrices=False)
    basis = np.ascontiguousarray(vt[:LATENT].T)
    return Model(idf, basis, _unit(w @ basis), y.astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on a bounded sample of the rows of ``docs`` that have a label."""
    python_ready(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("double").alias("y"))
    n = known.count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("_id", F.lit("knn")), F.lit(1 << 20)) / float(1 << 20)
    known = known.where(draw < min(1.0, max_labelled / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(known, "_id").select("text", "y", F.xxhash64("_id", "text").alias("h"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            for a, c in ranges(texts, 500_000):
                x = term_counts(texts[a:c])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(a, c - a), b.column(2).slice(a, c - a)],
                                                 names=["x", "y", "h"])

    got = rows.mapInArrow(terms, "x binary, y double, h bigint").orderBy("h").limit(2 * max_labelled).toArrow()  # the documented bound
    if not got.num_rows:
        return None
    x = np.frombuffer(b"".join(got["x"].to_pylist()), dtype=np.float32).reshape(got.num_rows, WIDTH)
    return fit(x, got["y"].to_numpy())


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("id", F.lit(PRIOR).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, c in ranges(texts, 500_000):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, c - a), pa.array(m.scores(texts[a:c]))], names=["id", "score"])

    return rows.mapInArrow(vote, f"id {dict(rows.dtypes)['id']}, score double")
