"""Language identification with interpolated Kneser-Ney character models.

One character model of order ``ORDER`` per language, learned from labelled rows.
Texts are lower-cased, runs of characters that are not letters become one blank.
n-grams are 64-bit hashes; per order the union over the languages is one sorted
hash array with a row of discounted probabilities (a column a language), and one
for contexts with the back-off weights, so a lookup is a binary search.  A text
gets the language of the lowest cross-entropy per character (ties: first by
name).

Calibration, on labelled rows kept out of the counts: a temperature turns the
entropies into probabilities, and for each language the entropy that
``1 - REJECT`` of its texts stay under is the limit beyond which a prediction is
rejected (``accepted`` false; ``identify(reject=True)`` then says ``und``).

The models are fitted on a sample of about ``TRAIN_DOCS`` texts a language of at
most ``TRAIN_CHARS`` characters, chosen by a hash of id and text; so their size
is bounded and they are broadcast.  Every text is scored whole.  Null texts and
texts without a letter are ``und`` with score 0.  Without any labelled row
everything is ``und``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import python_ready
from cloakline.llm.tokens import ranges

ORDER = 4
TRAIN_DOCS = 1000
TRAIN_CHARS = 20_000
REJECT = 0.005
UNKNOWN = "und"
_START, _P = 2, np.uint64(0x9E3779B97F4A7C15)
_GROUP_CHARS = 1_000_000
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after ORDER - 1 start marks, and the
    number of code points of each (marks not counted)."""
    marks = chr(_START) * (ORDER - 1)
    low = [marks + t.lower().replace(chr(_START), " ") + " " for t in texts]
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter, mark = _letters()[cp], cp == _START
    keep = letter | mark
    keep[1:] |= letter[:-1]  # the first of a run of others, as a blank
    cum = np.concatenate(([0], np.cumsum(keep)))
    ends = np.cumsum([len(x) for x in low])
    kept = np.diff(cum[np.concatenate(([0], ends))]) - (ORDER - 1)
    return np.where(letter | mark, cp, 32)[keep].astype(np.uint64), kept


def _hash(cp: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n code points that end at each place (n = 0: zeros)."""
    h = np.zeros(len(at), dtype=np.uint64)
    for k in range(n - 1, -1, -1):
        h = (h + cp[at - k] + np.uint64(1)) * _P
        h ^= h >> np.uint64(29)
    return h


def places(kept: np.ndarray) -> np.ndarray:
    """Where the scored code points stand."""
    start = np.cumsum(kept + (ORDER - 1)) - kept
    return np.repeat(start - (np.cumsum(kept) - kept), kept) + np.arange(kept.sum())


@dataclass
class Model:
    langs: list[str]
    grams: list[np.ndarray] = field(default_factory=list)  # per order, sorted hashes
    probs: list[np.ndarray] = field(default_factory=list)  # their discounted probabilities
    contexts: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    floor: np.ndarray | None = None  # per language 1 / (alphabet + 1)
    temperature: float = 1.0
    limits: np.ndarray | None = None

    def log_probs(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        p = np.broadcast_to(self.floor, (len(at), len(self.langs)))
        for n in range(1, ORDER + 1):
            a = _look(self.grams[n - 1], self.probs[n - 1], _hash(cp, at, n), 0.0)
            g = _look(self.contexts[n - 1], self.backoff[n - 1], _hash(cp, at - 1, n - 1), 1.0)
            p = a + g * p
        return np.log(p)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (text x language) and characters scored;
        a text without a letter has 0."""
        cp, kept = symbols(texts)
        out = np.zeros((len(texts), len(self.langs)))
        if kept.sum():
            at = places(kept)
            _, first, inverse = np.unique(_hash(cp, at, ORDER), return_index=True, return_inverse=True)
            lp = self.log_probs(cp, at[first])
            some = np.flatnonzero(kept > 0)
            start = (np.cumsum(kept) - kept)[some]
            for k in range(len(self.langs)):
                out[some, k] = -np.add.reduceat(lp[inverse, k], start) / kept[some]
        return out, kept


def _look(keys: np.ndarray, rows: np.ndarray, want: np.ndarray, missing: float) -> np.ndarray:
    i = np.searchsorted(keys, want)
    i[i == len(keys)] = 0
    return np.where((keys[i] == want)[:, None], rows[i], missing)


def fit(counts: dict[str, Counter]) -> Model:
    """Models from counts of ORDER-grams (as strings) per language."""
    langs = sorted(counts)
    m = Model(langs)
    terms: list[list[dict]] = [[{}, {}] for _ in range(ORDER)]
    alphabet = {ch for c in counts.values() for g in c for ch in g[-1]}
    m.floor = np.full(len(langs), 1.0 / (len(alphabet) + 1))
    for k, lang in enumerate(langs):
        level = counts[lang]
        for n in range(ORDER, 0, -1):
            ones = sum(v == 1 for v in level.values())
            twos = sum(v == 2 for v in level.values())
            d = ones / (ones + 2 * twos) if ones else 0.5
            d = min(max(d, 0.1), 0.9)
            total, kinds = Counter(), Counter()
            for g, v in level.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            for g, v in level.items():
                terms[n - 1][0].setdefault(g, np.zeros(len(langs)))[k] = (v - d) / total[g[:-1]]
            for c, v in total.items():
                terms[n - 1][1].setdefault(c, np.ones(len(langs)))[k] = d * kinds[c] / v
            lower = Counter()  # continuation counts: in how many contexts it was seen
            for g in level:
                lower[g[1:]] += 1
            level = lower
    for n, (grams, contexts) in enumerate(terms, 1):
        for found, size, keys, rows in ((grams, n, m.grams, m.probs), (contexts, n - 1, m.contexts, m.backoff)):
            cp = np.array([[ord(ch) for ch in g] for g in found], dtype=np.uint64).reshape(len(found), size)
            h = np.zeros(len(found), dtype=np.uint64)
            if size:
                h = _hash(cp.ravel(), np.arange(len(found)) * size + size - 1, size)
            order = np.argsort(h)
            keys.append(h[order])
            rows.append(np.array(list(found.values()))[order])
    return m


def calibrate(m: Model, entropy: np.ndarray, chars: np.ndarray, truth: np.ndarray) -> None:
    """Temperature of least log loss, and each language's limit."""
    m.limits = np.full(len(m.langs), np.inf)
    if not len(truth):
        return
    best, doubt = np.inf, 1 / (len(truth) + 2)  # smoothed targets: never certain
    for t in np.geomspace(1e-2, 20, 40):
        p = np.clip(posterior(entropy, chars, t)[np.arange(len(truth)), truth], 1e-12, 1 - 1e-12)
        loss = -((1 - doubt) * np.log(p) + doubt * np.log(1 - p)).mean()
        if loss < best:
            best, m.temperature = loss, float(t)
    for k in range(len(m.langs)):
        own = entropy[truth == k, k]
        if len(own):
            m.limits[k] = np.quantile(own, 1 - REJECT)


def posterior(entropy: np.ndarray, chars: np.ndarray, temperature: float) -> np.ndarray:
    # characters depend on each other: evidence grows with the root of the length
    z = -temperature * np.sqrt(chars)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
    e = np.exp(np.maximum(z, -700))
    return e / e.sum(axis=1, keepdims=True)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          train_docs: int = TRAIN_DOCS) -> Model | None:
    """Fit and calibrate on a bounded sample of ``labelled``."""
    python_ready(labelled.sparkSession)
    rows = (labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col, F.lit("langid")).alias("h")))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("h").alias("one")).collect()  # a row a language
    if not sizes:
        return None
    # whole texts, up to about train_docs of them and TRAIN_CHARS for each; one of every language is always learned from
    part = lambda r: min(1.0, 1.25 * train_docs / r["n"], 1.25 * train_docs * TRAIN_CHARS / max(r["chars"], 1))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(part(r)))])
    always = F.col("h") == F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(r["one"]))])[F.col("lang")]
    draw = F.pmod("h", F.lit(1 << 20)) / float(1 << 20)
    sample = (rows.where(always | (draw < share[F.col("lang")]))
              .withColumn("test", ~always & (F.pmod(F.shiftright("h", 24), F.lit(5)) == 0)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lang, text in zip(langs, texts):
                cp, kept = symbols([text])
                s = cp.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                found.setdefault(lang, Counter()).update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
        for lang, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())],
                                             names=["lang", "gram", "n"])

    grams = (sample.where("NOT test").select("lang", "text").mapInArrow(count, "lang string, gram string, n bigint")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    counts: dict[str, Counter] = {}
    for lang, gram, n in zip(*(c.to_pylist() for c in grams.toArrow().columns)):  # bounded by the sample
        counts.setdefault(lang, Counter())[gram] = n
    if not counts:
        return None
    model = fit(counts)
    model.limits = np.full(len(model.langs), np.inf)
    tests = _scored(sample.where("test").select(F.col("lang").alias("id"), "text"), model, "id string").toArrow().to_pydict()
    known = [i for i, x in enumerate(tests["id"]) if x in counts and tests["chars"][i]]
    calibrate(model, np.array([tests["entropy"][i] for i in known]).reshape(len(known), len(model.langs)),
              np.array([tests["chars"][i] for i in known]), np.array([model.langs.index(tests["id"][i]) for i in known], dtype=int))
    return model


def _scored(rows: DataFrame, model: Model, id_type: str) -> DataFrame:
    """id, entropy per language and characters of each row (id, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for x, y in ranges(texts, _GROUP_CHARS):
                entropy, chars = m.entropies(texts[x:y])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(entropy.tolist(), pa.list_(pa.float64())), pa.array(chars, pa.int64())],
                    names=["id", "entropy", "chars"])

    return rows.mapInArrow(score, f"{id_type}, entropy array<double>, chars bigint")


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """lang_pred, score, entropy (of the chosen language) and accepted, per row."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("entropy"), F.lit(False).alias("accepted"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for x, y in ranges(texts, _GROUP_CHARS):
                entropy, chars = m.entropies(texts[x:y])
                best = entropy.argmin(axis=1)
                own = entropy[np.arange(len(best)), best]
                p = posterior(entropy, chars, m.temperature)[np.arange(len(best)), best]
                # a text of marks and blanks only has no letter: nothing was scored
                none = chars == 0
                ok = ~none & (own <= m.limits[best])
                name = [UNKNOWN if n or (reject and not a) else m.langs[i] for n, a, i in zip(none, ok, best)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(name, pa.string()), pa.array(np.where(none, 0.0, p)),
                     pa.array(np.where(none, np.nan, own)), pa.array(ok)],
                    names=["id", "lang_pred", "score", "entropy", "accepted"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(choose, f"id {kind}, lang_pred string, score double, entropy double, accepted boolean")
