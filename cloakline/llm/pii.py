"""Personal data by weak supervision (DataFrame functions only).

Base spans are the four patterns of ``BASE`` with their checks.  On top, every
match of a pattern, passing or not, and every secret-like token is a candidate
on which labelers vote for, against or not at all: regex (checksum and range
checks, key shapes), gazetteer (mail domains, dialling codes, card issuers) and
context labelers (assignment to a secret's name, the word before, what stands
around, the mix of characters).  Votes are counted per pattern of votes (at most
3 ^ labelers rows whatever the corpus); expectation-maximisation on that table
gives each labeler's reliability and each pattern's probability.  These
probabilities, summed per feature value (a fixed set), train the final naive
Bayes span classifier, which scores every candidate in its own row.  Accepted
candidates that overlap no base span are added; base spans always stay.  (A
match that fails the check of its own kind votes and teaches as a counterexample
but is never added.)

No join, no shuffle of texts: only vote and feature counts are aggregated.
Offsets are code points, end exclusive.  Null text counts as empty.  Repeated
rows get equal spans; without candidates nothing is added.  The patterns loop
over character classes only, so a very long run neither overflows the regex
engine's stack nor makes it quadratic.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakline.llm.common import packed, written

KINDS = ["email", "ip", "card", "phone", "secret", "phone"]  # the last: in national form
DIGITS = "[0-9]"
_DOT, _OTHER = "", ""
_LOCAL = f"[A-Za-z0-9._%+{_DOT}-]"
#: same matches as the contract's patterns on the prepared texts below
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
RUN = r"[0-9][0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_NAMES = "password|passwd|pwd|secret|token|api_?key|access_?key"
ASSIGNED = rf"(?i:(?<![a-z0-9_])(?:{_NAMES})[\"']?\x20{{0,3}}[=:]\x20{{0,3}}[\"']?[^\s\"']{{6,}}+[\"']?)"
BARE = r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+"
SECRET = f"{ASSIGNED}|{BARE}"
NATIONAL = r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])"
SPAN = "array<struct<k:int,s:bigint,e:bigint>>"

# gazetteers (fixed values)
MAIL_DOMAINS = r"(?i)[@.](?:gmail|yahoo|hotmail|outlook|icloud|proton|gmx|web|orange|free|mail\d*|example)\.|\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|io)$"
DIALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6(?:011|5))"
GOOD_WORDS = ["email", "mail", "contact", "call", "phone", "tel", "fax", "mobile", "ip", "host", "address", "card", "visa",
              "password", "token", "secret", "key", "login", "correo", "telefono", "telefon", "courriel"]
BAD_WORDS = ["version", "page", "isbn", "figure", "table", "chapter", "section", "release", "build", "order", "issue"]
LABELERS = ["check", "shape", "assigned", "gazetteer", "word", "mix", "alone"]


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Array of (kind, start, end) of the leftmost non-overlapping matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(found, gaps, lambda m, g: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("m")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _empty(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        new = F.struct(F.lit(kind).alias("k"), s.alias("s"), (s + x["m"]).alias("e"))
        return F.struct((s + x["m"]).alias("at"), F.concat(acc["out"], F.array(new)).alias("out"))

    return F.aggregate(F.filter(steps, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    ds = F.split(F.reverse(digits), "")

    def value(c: Column, i: Column) -> Column:
        d = F.coalesce(c.cast("int"), F.lit(0)) * (i % 2 + 1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(ds, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(k: Column, v: Column) -> Column:
    """The contract's check of a base match."""
    n = F.length(_digits(v))
    parts = F.transform(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    return (F.when(k == 0, F.lit(True)).when(k == 1, octets)
            .when(k == 2, F.when(n.between(12, 19), _luhn(_digits(v))).otherwise(F.lit(False)))
            .when(k == 3, n.between(9, 15)).otherwise(F.lit(False)))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` (spans) and ``_cand`` (candidates with votes and features)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn("_t", t).withColumn("_d", F.col("_t").rlike(DIGITS))
    t = F.col("_t")
    # dots that do not part two label characters become marks, so the domain is one character class
    mail = F.regexp_replace(F.translate(t, _DOT, _OTHER), r"(?<![A-Za-z0-9-])\.|\.(?![A-Za-z0-9-])", _DOT)
    # blanks and hyphens that do not stand single between digits become letters
    runs = F.regexp_replace(t, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "x")
    raw = F.concat(
        F.when(F.instr(t, "@") > 0, matches(mail, EMAIL, 0)).otherwise(_empty(SPAN)),
        F.when(F.col("_d") & t.rlike(r"[0-9]\.[0-9]"), matches(t, IP, 1)).otherwise(_empty(SPAN)),
        F.when(F.col("_d") & t.rlike(r"[0-9][0-9\x20-]{10}"), F.filter(matches(runs, RUN, 2), lambda x: x["e"] - x["s"] > 8)).otherwise(_empty(SPAN)),
        F.when(F.instr(t, "+") > 0, matches(t, PHONE, 3)).otherwise(_empty(SPAN)),
        F.when(F.col("_d"), matches(t, SECRET, 4)).when(t.rlike("[=:]"), matches(t, ASSIGNED, 4)).otherwise(_empty(SPAN)),  # a bare key holds a digit
        F.when(F.col("_d"), matches(t, NATIONAL, 5)).otherwise(_empty(SPAN)))

    def described(x: Column) -> Column:
        v = F.substring(F.col("_t"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))
        before = F.substring(F.col("_t"), F.greatest(x["s"] - 39, F.lit(1)).cast("int"), F.least(x["s"], F.lit(40)).cast("int"))
        after = F.substring(F.col("_t"), (x["e"] + 1).cast("int"), F.lit(1))
        return F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"), v.alias("v"), before.alias("b"), after.alias("a"))

    df = df.withColumn("_raw", raw)
    df = df.withColumn("_raw", F.transform("_raw", described))
    df = df.withColumn("_cand", F.transform("_raw", _judged))
    base = F.transform(F.filter("_cand", lambda c: c["ok"]), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return df.withColumn("_base", F.array_sort(base, _by_start)).drop("_t", "_d", "_raw")


def _by_start(a: Column, b: Column) -> Column:
    return (F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1)
            .when(a["e"] < b["e"], -1).when(a["e"] > b["e"], 1).otherwise(0))


def _judged(x: Column) -> Column:
    """A candidate's check, vote pattern (base 3 digits) and features."""
    k, v = x["k"], x["v"]
    ok = _valid(k, v)
    word = F.lower(F.regexp_extract(x["b"], r"([A-Za-z]+)[^A-Za-z]*$", 1))
    digits, size = F.length(_digits(v)), F.length(v)
    assigned = v.rlike(rf"(?i)^(?:{_NAMES})[\"']?\x20{{0,3}}[=:]") & (k == 4)
    shape = v.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{16}$|^(?:gh[pousr]|sk|pk)[_-]?[A-Za-z0-9]{16,}$|[0-9a-f]{16}")
    listed = (F.when(k == 0, v.rlike(MAIL_DOMAINS)).when(k == 2, _digits(v).rlike(ISSUERS)).when(k == 3, v.rlike(DIALLING)).otherwise(F.lit(False)))
    classes = sum((v.rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0))
    alone = x["b"].rlike(r"(?:^|[\s\"'(<:;,])$") & x["a"].rlike(r"^(?:$|[\s\"').,;:>!?])")
    votes = [
        F.when(k >= 4, 0).when(ok, 1).otherwise(-1),
        F.when((k == 4) & shape, 1).otherwise(0),
        F.when(assigned, 1).otherwise(0),
        F.when(listed, 1).when(k.isin(0, 3), -1).otherwise(0),
        F.when(word.isin(GOOD_WORDS), 1).when(word.isin(BAD_WORDS), -1).otherwise(0),
        F.when((classes >= 2) & (digits >= 2), 1).when(v.rlike(r"(.)\1{7}"), -1).otherwise(0),
        F.when(alone, 1).otherwise(-1),
    ]
    pattern = sum(((vote + 1) * 3 ** i for i, vote in enumerate(votes)), F.lit(0))
    bucket = lambda c, n: F.least(c, F.lit(n)).cast("string")
    features = F.array(*[F.concat(F.lit(f"{name}="), value) for name, value in (
        ("kind", k.cast("string")), ("ok", F.concat(k.cast("string"), ok.cast("string"))), ("size", bucket(F.floor(size / 4), 12)),
        ("digits", bucket(digits, 20)), ("classes", F.concat(k.cast("string"), classes.cast("string"))), ("shape", F.concat(k.cast("string"), shape.cast("string"))),
        ("assigned", assigned.cast("string")), ("listed", F.concat(k.cast("string"), F.coalesce(listed, F.lit(False)).cast("string"))),
        ("word", F.when(word.isin(GOOD_WORDS + BAD_WORDS), word).otherwise(F.lit("-"))), ("alone", alone.cast("string")))])
    return F.struct(k.alias("k"), x["s"].alias("s"), x["e"].alias("e"), (ok & (k < 4)).alias("ok"), pattern.cast("int").alias("p"), features.alias("f"))


def reliabilities(patterns: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], list[list[list[float]]]]:
    """Expectation-maximisation over counted vote patterns: probability of each
    pattern, and per labeler and class the shares of votes -1, 0 and 1.

    Starts from the majority; a few pseudo-votes that labelers are rather right
    than wrong keep the two classes from changing places."""
    votes = {p: [p // 3 ** i % 3 for i in range(len(LABELERS))] for p in patterns}
    prob = {p: 1 / (1 + math.exp(-sum(x - 1 for x in v))) for p, v in votes.items()}
    table: list[list[list[float]]] = []
    for _ in range(rounds):
        table = []
        for j in range(len(LABELERS)):
            sums = [[4.0, 4.0, 2.0], [2.0, 4.0, 4.0]]
            for p, n in patterns.items():
                sums[1][votes[p][j]] += n * prob[p]
                sums[0][votes[p][j]] += n * (1 - prob[p])
            table.append([[x / sum(row) for x in row] for row in sums])
        total = sum(patterns.values())
        prior = (sum(n * prob[p] for p, n in patterns.items()) + 1) / (total + 2)
        new = {}
        for p, v in votes.items():
            z = math.log(prior / (1 - prior)) + sum(math.log(table[j][1][x] / table[j][0][x]) for j, x in enumerate(v))
            new[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))
        moved = max((abs(new[p] - prob[p]) for p in new), default=0.0)
        prob = new
        if moved < 1e-9:
            break
    return prob, table


def train(rows: DataFrame) -> tuple[float, dict[str, float]]:
    """Bias and log-odds per feature value of the span classifier, from the
    candidates of ``scanned``."""
    cand = rows.select(F.explode("_cand").alias("c")).select("c.p", "c.f")
    patterns = {r["p"]: r["n"] for r in cand.groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most 3 ^ 7
    if not patterns:
        return 0.0, {}
    prob, _ = reliabilities(patterns)
    p = F.element_at(F.create_map(*[x for k, v in sorted(prob.items()) for x in (F.lit(k), F.lit(v))]), F.col("p"))
    # features of a vote pattern first, so that a few hundred rows are weighed
    by = cand.select("p", F.explode("f").alias("f")).groupBy("p", "f").agg(F.count("*").alias("n"))
    sums = by.groupBy("f").agg(F.sum(p * F.col("n")).alias("yes"), F.sum((1 - p) * F.col("n")).alias("no")).collect()  # fixed set of values
    yes = sum(n * prob[k] for k, n in patterns.items()) + 1
    no = sum(n * (1 - prob[k]) for k, n in patterns.items()) + 1
    weights = {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    return math.log(yes / no), weights


def with_spans(rows: DataFrame, model: tuple[float, dict[str, float]]) -> DataFrame:
    """Add ``_spans``: the base spans and the accepted candidates."""
    bias, weights = model
    if not weights:
        return rows.withColumn("_spans", F.col("_base"))
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(v))])

    def accepted(c: Column) -> Column:
        score = F.aggregate(c["f"], F.lit(bias), lambda a, f: a + F.coalesce(table[f], F.lit(0.0)))
        clash = F.exists("_base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"]))
        return (c["k"] >= 4) & (score > 0) & ~clash

    added = F.transform(F.filter("_cand", accepted), lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), c["e"].alias("e")))
    return rows.withColumn("_spans", F.array_sort(F.concat("_base", added), _by_start))


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"], x["e"])), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans and all spans of every row."""
    rows = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).drop("text")
    rows = written(rows, "pii-candidates")
    return with_spans(rows, train(rows)).select("doc_id", F.col("_base").alias("base"), F.col("_spans").alias("spans"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole rows of ``docs`` with every span of the text replaced by its kind
    in angle brackets (overlapping spans: one replacement by the first)."""
    rows = written(scanned(packed(docs), f"_all.{text_col}"), "pii-rows")
    found = with_spans(rows, train(rows))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _empty("array<string>").alias("out"))
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col(f"_all.{text_col}")

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        return F.when(x["s"] < acc["at"], F.struct(F.greatest(acc["at"], x["e"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(x["e"].alias("at"), F.concat(acc["out"], F.array(gap, kinds[x["k"]])).alias("out")))

    new = F.aggregate("_spans", start, step,
                      lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    changed = F.col("_all").withField(text_col, F.when(F.size("_spans") > 0, new).otherwise(text))
    return found.select(changed.alias("_all")).select("_all.*")
