import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from corpus_fixtures import SF001, edge, none  # noqa: F401

from cloakline.llm import mixing, pii, quality_rules, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF001)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    want = Counter(key([row[rel.columns.index(c)] for c in cols]) for row in rel.fetchall())
    assert want == Counter(key([r[c] for c in cols]) for r in df.collect())


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + d for s in at.values() if len(s) > 1 for i in s for d in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_counts(spark, edge, none):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["a", "b", "|", "É", "c\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    more = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for data in (edge, more):
        got = quality_rules.verdicts(data).collect()
        fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert Counter((r.doc_id, *(r[f] for f in fields)) for r in got) == Counter((r.doc_id, *counts(r.text)) for r in data.collect())
        assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.verdicts(none).count() == 0 and quality_rules.keep_good(none).count() == 0
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in quality_rules.verdicts(edge).where("kept").collect())


def fill(sizes, weights, cap=3):
    """Targets by repeated resharing."""
    total, stopped = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in stopped]
        if not free:
            return [stopped[i] for i in range(len(sizes))]
        left = total - sum(stopped.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] >= cap * sizes[i]]
        if not over:
            return [stopped.get(i, share.get(i)) for i in range(len(sizes))]
        stopped |= {i: cap * sizes[i] for i in over}


@pytest.mark.parametrize("bucket_rows", [65_536, 20])
def test_mix(spark, bucket_rows):
    rnd = random.Random(7)
    per = {"a": 400, "b": 3, "c": 60, None: 25, "é": 40, "z": 5}
    rows = [(n, "w " * rnd.choice([0, 1, 5, 20, 60]), s) for n, s in enumerate(s for s, k in per.items() for _ in range(k))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    m = mixing.measured(df)
    plan = mixing.cuts(m, mixing.targets(m), len(rows), bucket_rows)
    got = mixing.copies(m, plan).collect()
    order = sorted(per, key=lambda s: (s is None, s))
    sizes = [sum(t.count("w") for _, t, s in rows if s == o) for o in order]
    want = fill(sizes, [i % 3 + 1 for i in range(len(order))])
    for o, s, t in zip(order, sizes, want):
        own = [r for r in got if r["_source"] == o]
        assert len(own) == per[o] and all(r.source_size == s and abs(r.target - t) < 1e-6 and 0 <= r.copies <= 3 for r in own)
        whole = t // s if s else 0
        assert all(r.copies in (whole, whole + 1) for r in own)
        assert abs(sum(r.copies * r["_size"] for r in own) - t) <= 30
    again = mixing.copies(m, mixing.cuts(mixing.measured(df.repartition(2)), mixing.targets(m), len(rows), bucket_rows)).collect()
    assert Counter((r["_id"], r.copies) for r in got) == Counter((r["_id"], r.copies) for r in again)


@pytest.mark.parametrize("bucket_rows", [65_536, 7])
def test_mix_passes_go_on_into_later_buckets(spark, tmp_path, bucket_rows):
    """Equal to the SQL, whose passes see all rows, with many buckets a source and skewed sizes."""
    rnd = random.Random(5)
    rows = [(n, "w " * int(rnd.paretovariate(0.7)) if n % 9 else "w " * rnd.randint(300, 900), f"s{n % 13 % 5}") for n in range(900)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents")
    df = spark.read.parquet(f"{tmp_path}/documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    m = mixing.measured(df)
    got = mixing.copies(m, mixing.cuts(m, mixing.targets(m), len(rows), bucket_rows)).collect()
    want = con.sql(f"SELECT doc_id, taken FROM ({queries.ORACLES['op4_pareto_mix']})").fetchall()
    assert Counter(want) == Counter((r["_id"], r.copies * r["_size"]) for r in got)


def test_mix_edges(spark, edge, none):
    out = mixing.mixed(edge)
    assert out.columns == edge.columns and out.count() > 0
    assert mixing.mixed(none).count() == 0
    empty = edge.where("text IS NULL OR text = ''")
    assert mixing.mixed(empty).count() == 0  # nothing to take


def base_spans(text):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                           r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn
                    or k == 3 and 9 <= len(d) <= 15):
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_equal_the_plain_patterns(spark, edge, none):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 50)))
             for chars in ("a.@-+1 ", "0123 -4", "1.2. 5", "+12() .-a", "4111 1é-😀@.x+\n") for _ in range(400)]
    texts += ["1 " * 20_000, "1" * 50_000, "x@" + "a." * 20_000 + "c", "+1" + " 2" * 9_000, "a@b.c" * 500, "a@b.c+d@e.f", "-" * 50_000, "1.2." * 5_000]
    fuzz = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    for data in (fuzz, edge):
        got = Counter((r.doc_id, tuple((s.k, s.s, s.e) for s in r.base)) for r in pii.find(data).collect())
        assert got == Counter((r.doc_id, tuple(base_spans(r.text))) for r in data.collect())
    assert pii.find(none).count() == 0 and pii.masked(none).count() == 0


def test_pii_query_and_masking(spark, edge):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op10_pii(spark, SF001).collect()}
    assert found.keys() == texts.keys()
    for i, r in found.items():
        base = base_spans(texts[i])
        spelled = [f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base]
        assert hashlib.sha256(",".join(spelled).encode()).hexdigest() == r.base_sha256 and set(spelled) <= set(r.spans.split(",") if r.spans else [])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in range(4)]
    clean = [i for i, t in texts.items() if not re.search(r"[0-9@]", t)]
    assert clean and all(found[i].spans == "" for i in clean)
    out = pii.masked(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[8] == "mail <EMAIL> or <PHONE>, card <CARD>, host <IP>" and got[4] is None and got[5] == ""
    assert got[11].startswith("<SECRET> é😀 <EMAIL>") and got[9] == "4711 !!! ***"


def secrets(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [[(c.s, c.e) for c in r._cand if c.k == 4] for r in pii.scanned(df).orderBy("doc_id").collect()]


def test_secrets_to_their_end(spark):
    texts = [f"{name}{('Zq7.' if name else 'Zq7x') * 5_000}"[:len(name) + n] + " end" for n in (86, 128, 201, 600, 20_000) for name in ("", "token=")]
    assert secrets(spark, texts) == [[(0, len(t) - 4)] for t in texts]
    assert secrets(spark, ["a" * 50_000, "1" * 50_000, "a " * 20_000 + "1"]) == [[], [], []]


def test_assigned_secret_needs_no_digit(spark):
    texts = ["password = hunterhunter end", "Api_Key: correcthorse", "password = hunterhunter end 7", "no secret: none", "password hunterhunter"]
    assert secrets(spark, texts) == [[(0, 23)], [(0, 21)], [(0, 23)], [], []]


def test_reliabilities_find_the_better_labeler():
    rnd = random.Random(1)
    patterns = Counter()
    n = len(pii.LABELERS)
    for _ in range(4000):
        y = rnd.random() < 0.4
        votes = [(2 if (rnd.random() < acc) == y else 0) for acc in [0.95, 0.9, 0.85] + [0.6] * (n - 3)]
        patterns[sum(v * 3 ** i for i, v in enumerate(votes))] += 1
    _, table = pii.reliabilities(patterns)
    assert table[0][1][2] > 0.9 and table[0][0][0] > 0.9 and 0.5 < table[n - 1][1][2] < 0.7


@pytest.mark.parametrize("module", ["quality_rules", "pii"])
def test_native_modules_have_no_python_tasks(module):
    text = (Path(queries.__file__).parent / f"{module}.py").read_text()
    assert not re.search(r"udf|mapIn|applyIn|pandas|pyarrow|\.rdd|numpy", text, re.IGNORECASE)
