"""Masking on small fixtures, held against a per-character claim array."""

import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import claims
from cloakline.functions.dialect import Untranslatable, to_java
from cloakline.operators.spans import candidates_table, detect, overlaps
from cloakline.plans.jobs import entity_lists, mask, restore, to_units
from cloakline.rules import EXAMPLE_CONFIG, build_rules, load_config, load_rules, rule
from conftest import mask_cases

EMAIL = rule("email", "person{n:03d}@anon.invalid", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b")
NAME = rule("name", "Person{n:03d}", r"\b[A-Z][a-z]{1,25}(?:\s+[A-Z][a-z]{1,25}){1,3}\b", min_word_length=2,
            exclusions=["April", "Sunday", "Appendix"])
ID = rule("id", "preserve_length", r"\b\d{7,8}\b")
USER = rule("username", "user{n:04d}xx", r"\b(?=[a-zA-Z0-9]*[a-zA-Z])(?=[a-zA-Z0-9]*\d)[a-zA-Z0-9]{8}\b")
ALL = [EMAIL, NAME, ID, USER]

CASES = {
    "write to kim@post.example.org, or lee+x@post.example.org": "write to person001@anon.invalid, or person002@anon.invalid",
    "parcel 7000001 replaces 7000002; 7000001 is lost": "parcel 0000001 replaces 0000002; 0000001 is lost",
    "six 654321 and nine 987654321 digits stay": "six 654321 and nine 987654321 digits stay",
    "badge qz81kk02 opens, badge qz81kk0 does not": "badge user0001xx opens, badge qz81kk0 does not",
    "Ada Vogel met Uwe Anders Holm": "Person001 met Person002",
    "April Vogel is a pun, Sunday too": "April Vogel is a pun, Sunday too",
    "Ada.Vogel@post.example.org is one value": "person001@anon.invalid is one value",
    "  \t ": "  \t ",
    "": "",
    "nothing of interest": "nothing of interest",
}


def test_cases(spark):
    texts, maps = mask_cases(spark, [*CASES, None], ALL)
    assert texts == [*CASES.values(), None]
    for case, text, mapping in zip(CASES, texts, maps):
        assert (text, mapping) == claims.masked(case, ALL)


def test_overlap_predicate_equals_shared_positions(spark):
    rnd = random.Random(17)
    rows = []
    for _ in range(400):
        kept = [(s, s + rnd.randint(1, 6)) for s in (rnd.randint(0, 30) for _ in range(rnd.randint(0, 4)))]
        s = rnd.randint(0, 30)
        rows.append((kept, s, s + rnd.randint(1, 6)))
    df = spark.createDataFrame(rows, "kept array<struct<s:int,e:int>>, s int, e int")
    for r in df.select("*", overlaps(F.col("kept"), F.col("s"), F.col("e")).alias("hit")).collect():
        taken = {p for k in r.kept for p in range(k.s, k.e)}
        assert r.hit == bool(taken & set(range(r.s, r.e)))


def _edge_text(rnd):
    pieces = ["a@b.co", ".a@b.co", "é.a@b.co", "+a@b.co", "1234567", "12345678", "123456789", "ab12cd34",
              "Alice Smith", "Mary Anne Jones Lee Ray", "Ünal Ölmez", "John Smith", "٣٤٥٦٧٨٩", "²1234567",
              "René Dupont", "x‍y", "\u001c", "😀", "January Alice", "Jo A", "O'Brien Smith",
              "Smith_John Doe", "Abcdefghijklmnopqrstuvwxyzab Cd", "SW1A 1AA", "AB123456C", "07700 900123",
              " ", "\n", "\t", ",", "-", "_", "(", ")", "Ab", "Cd Ef", "Alice\u00a0Smith",
              "Rene\u0301 Dupont", "\u2028", "Ana\u3000Lee", "\u00b2\u00b3"]
    return "".join(rnd.choice(pieces) + rnd.choice(["", " ", "", ".", " "]) for _ in range(rnd.randint(0, 12)))


@pytest.mark.parametrize("scoped", [True, False])
def test_random_texts_equal_claims(spark, scoped):
    """In-row numbering (a registry per text) and the distributed registry."""
    rnd = random.Random(3)
    texts = [_edge_text(rnd) for _ in range(300)]
    rules = load_rules(proper_nouns=True) + build_rules(load_config(EXAMPLE_CONFIG))
    df = spark.createDataFrame([(i, i % 7, t) for i, t in enumerate(texts)], "id long, part int, text string")
    if scoped:
        r = mask(df, "text", ["id"], ["id"], rules=rules)
        got = {x.id: x.text for x in r.masked.collect()}
        assert got == {i: claims.masked(t, rules)[0] for i, t in enumerate(texts)}
        pairs = {(x.id, x.pseudonym): x.original for x in r.mapping.collect()}
        assert {p for i, p in pairs if i == 5} == set(claims.masked(texts[5], rules)[1])
    else:  # one text is the whole scope: the other path, same result
        sep = " \u2603 "
        whole = spark.createDataFrame([(0, 0, sep.join(texts))], "id long, part int, text string")
        got = mask(whole, "text", ["id"], ["part"], rules=rules).masked.first()["text"]
        assert got == claims.masked(sep.join(texts), rules)[0]


def test_native_spans_equal_python_re(spark):
    rnd = random.Random(7)
    texts = [_edge_text(rnd) for _ in range(2000)] + ["\ue000 a@b.co \ue000Alice Smith 1234567", "x\ue000y@z.io"]
    rules = load_rules(proper_nouns=True) + build_rules(load_config(EXAMPLE_CONFIG))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, _text string").repartition(8)
    got = sorted((r.id, r.k, r.s, r.e, r.v) for r in candidates_table(df, rules, ["id"]).collect())
    assert got == sorted((i, *m) for i, t in enumerate(texts) if t.strip() for m in claims.matches(t, rules))


def test_many_matches_and_overlapping_entities(spark):
    """One route for short and very long texts: an e-mail claims part of an
    entity, the next entity overlaps the first and is free."""
    name = rule("name", "P{n}", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", spacy_ner=True)
    rules = [EMAIL, name, ID]
    for reps in (1, 1500):
        text = "kk@ll.mm Ada Vogel Holm " + "7000001 x " * reps
        ents = [(3, 14, "PERSON"), (9, 18, "PERSON"), (13, 23, "PERSON")]
        df = spark.createDataFrame([(1, text)], "id long, text string")
        e = spark.createDataFrame([(1, *x) for x in ents], "id long, s int, e int, label string")
        got = mask(df, "text", ["id"], None, rules=rules, entities=e).masked.first()["text"]
        assert got == claims.masked(text, rules, ents)[0] and got.startswith("person001@anon.invalid P1 Holm 0000001")


def test_long_text_is_not_quadratic(spark):
    text = "7000001 qz81kk02 " * 20_000
    df = spark.createDataFrame([(1, text)], "id long, _text string")
    assert df.transform(lambda d: detect(d, ALL)).select(F.size("_spans")).first()[0] == 40_000


def test_rows_sharing_a_key_keep_their_words(spark):
    df = spark.createDataFrame([(1, "a", "kk@ll.mm one"), (1, "a", "two nn@oo.pp"), (1, "a", "kk@ll.mm one")],
                               "id long, f string, text string")
    for scope in (["f"], None):
        got = sorted(r.text for r in mask(df, "text", ["id"], scope, rules=[EMAIL]).masked.collect())
        assert [t.replace("001", "#").replace("002", "#") for t in got] == [
            "person#@anon.invalid one", "person#@anon.invalid one", "two person#@anon.invalid"]


def test_single_pass_and_sequential_restore(spark):
    x = rule("x", "X{n}", r"\bq\d+\b")
    texts = ["kk@ll.mm \ue000 z", "q7 is q8", "q7", "nothing", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    r = mask(df, "text", ["id"], None, rules=[EMAIL, x])
    for mode in ("sequential", "single_pass"):
        got = dict(restore(r.masked, "text", ["id"], r.mapping, None, mode=mode).collect())
        assert got == dict(enumerate(texts))
    glued = spark.createDataFrame([(0, "X15")], "id long, text string")  # a digit follows the pseudonym
    assert restore(glued, "text", ["id"], r.mapping, None, mode="single_pass").first()["text"] == "q75"
    with pytest.raises(ValueError, match="empty"):
        restore(df, "text", ["id"], r.mapping.where("false"), None)


def test_sequential_restore_equals_every_entry_in_turn(spark):
    """Entries brought in by a replacement, across its borders too."""
    entries = [("ab1", "zz22"), ("2", "ab"), ("zz", "ab1"), ("abab1", "#"), ("1", "2"), ("q", "{q}")]
    texts = ["ab1", "zz1", "ab ab1", "x2y", "1zz1", "qq", "none", ""]
    want = {}
    for i, t in enumerate(texts):
        for p, o in sorted(entries, key=lambda e: -len(e[0])):
            t = t.replace(p, o)
        want[i] = t
    m = spark.createDataFrame([(p, o, i) for i, (p, o) in enumerate(entries)], "pseudonym string, original string, order int")
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert dict(restore(df, "text", ["id"], m, None).collect()) == want


_ATOMS = ["a", "7", r"\\", r"\.", "[a-c]", r"[\\d]", r"[\d\\s]", r"[\w\-]", r"[^\s\\]", r"\d", r"\w", "(?:ab|7)", r"[\]\\w]"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.tuples(st.sampled_from(_ATOMS), st.sampled_from(["", "+", "{1,2}"])), min_size=1, max_size=4),
                          st.sampled_from([0, re.ASCII, re.IGNORECASE])), min_size=12, max_size=12))
def test_generated_patterns_equal_python_re(spark, specs):
    texts = ["aab7\\d.s w", "\\w]C-٣é", "pNd p{Nd}z \\\\", "7ab7.AB_\u00a0\\s", "dws]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for atoms, flags in specs:
        pattern = "".join(a + q for a, q in atoms)
        try:
            java = to_java(pattern, flags).pattern
        except Untranslatable:
            continue
        got = [r[0] for r in df.select(F.regexp_extract_all("t", F.lit(java), F.lit(0))).collect()]
        assert got == [[m.group() for m in re.finditer(pattern, t, flags)] for t in texts], (pattern, java)


def test_python_fallback_rule(spark):
    odd = rule("odd", "Q{n}", r"(a)?(?(1)b|c)x")  # conditional: not translatable
    assert not odd.native
    texts, _ = mask_cases(spark, ["cx and abx then bx cx"], [odd])
    assert texts == ["Q1 and Q2 then bx Q1"]


def test_partition_invariance(spark):
    """Same registry for 1, 7 and 200 shuffle partitions."""
    from cloakline.sources.fixtures import order_units

    units = order_units(spark, "/root/testdata/sf0.001")
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            r = mask(units, "text", ["unit_seq"], None, rules=load_rules())
            seen.append(sorted(tuple(x) for x in r.registry.select("rule", "original", "n", "pseudonym").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] == seen[2]


def test_hot_values_are_salted(spark, monkeypatch):
    """A value in half of all rows, and a frequent number that is no pseudonym."""
    import cloakline.operators.registry as regmod

    monkeypatch.setattr(regmod, "HOT_ROWS", 2)
    texts = [("kk@ll.mm" if i % 2 else f"n{i}@ll.mm") + " 0000 7000001" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    r = mask(df, "text", ["id"], None, rules=ALL)
    hot = regmod.hot_keys(r.internal, ["_scope", "rule", "key"], "occurrences").collect()
    assert hot and all(h["_salts"] > 1 for h in hot) and len(hot) <= 8 * 8
    for mode in ("single_pass", "sequential"):
        assert dict(restore(r.masked, "text", ["id"], r.mapping, None, mode=mode).collect()) == dict(enumerate(texts))
    assert r.cached and r.unpersist() is None


def test_own_scope_needs_no_exchange(spark, monkeypatch):
    import cloakline.session as session

    monkeypatch.setattr(session, "SPREAD_BYTES", 0)  # as for a table with splits enough
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    plan = mask(docs, "text", ["doc_id"], ["doc_id"], rules=load_rules()).masked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "InMemoryTableScan" not in plan and "Join" not in plan
    assert "EqualTo(lang,en)" in plan and "source" not in plan.split("ReadSchema:")[1]


def test_few_matches_are_taken_without_a_fold(spark):
    """Texts with any number of matches give the same spans as ``re``; exclusions split a value once."""
    from cloakline.operators import spans as ops

    rx = rule("d", "D{n}", r"[0-9]+")
    texts = [" é".join(str(10 ** (i % 5) + i) for i in range(n)) + "z" * (n % 3) for n in range(12)] + ["", None, "x\ue0001y22"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, _text string")
    got = {r.id: [(x.s, x.e, x.v) for x in r.c] for r in df.where("_text IS NOT NULL").select("id", ops.regex_candidates(F.col("_text"), rx, 0).alias("c")).collect()}
    assert got == {i: [(m.start(), m.end(), m[0]) for m in re.finditer(r"[0-9]+", t)] for i, t in enumerate(texts) if t is not None}
    named = rule("n", "N{n}", r"[A-Z][a-z]+ [A-Z][a-z]+", min_word_length=2, exclusions=["May"])
    plan = str(ops.passes_exclusions(F.col("v"), named))
    assert plan.count("split(") == 1


def test_boundary_stands_ahead_of_look_aheads():
    """The look-aheads of the username rule are not tried inside words."""
    rule = next(r for r in load_rules() if r.name == "username")
    assert rule.java.startswith("(?d)(?<![") and rule.java.index("(?<!") < rule.java.index("(?=")


def test_scans_refuse_early(spark):
    """A class in front of a character that it does not hold keeps what it took; a body of
    fixed length is tried ahead of the look-aheads.  The matches are those of Python."""
    java = {r.name: r.java for r in load_rules()}
    assert "[a-zA-Z0-9._%+\\-]*+@" in java["email"]
    assert java["username"].index("[a-zA-Z0-9]{8}") < java["username"].index("(?=[a-zA-Z0-9]*")
    for kept in (r"[a-z]+k", r"[a-z@]+@", r"[a-z]*@?b", r"[a-z]+\x40", r"[\w]+@", r"[a-z]+?@", r"\b(?=a(b)?)[a-c]{2}\1x", r"\b(?=\d)[\da-z]+"):
        assert "+@" not in to_java(kept).pattern.replace("]+@", "") and to_java(kept).pattern.count("{2}") <= 1
    patterns = [r"\b[a-z.]+@[a-z]+-b", r"x[a-c]{2,3}-[a-b]*\.", r"\b(?=[a-z]*\d)(?!ab)[a-z0-9]{3}\b", r"\b(?=[a-c0-9]*[a-c])[a-c0-9]{2}x\b"]
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("abcx1.@- é٣_") for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    texts += ["a.b@c-b", "xabc-ab.", "a1b 1aa ab1 1ab", "é1ab a1x 1cx_ a1x", ".a@a-b", "b1x-b1x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select("t", *[F.regexp_extract_all("t", F.lit(to_java(p).pattern), F.lit(0)).alias(f"p{i}") for i, p in enumerate(patterns)]).collect()
    for i, p in enumerate(patterns):
        want = {t: [m.group() for m in re.finditer(p, t)] for t in texts}
        assert any(want.values()) and all(r[f"p{i}"] == want[r.t] for r in found)


def test_small_scopes_move_once_and_equal_the_way_of_large_ones(spark, monkeypatch):
    """Nothing is cached or joined; keys and whole rows repeat, scopes, keys and texts are null."""
    from cloakline.plans import jobs

    text = "Alice Jones met Bob Smith, mail a@b.org or c@d.org; Alice Jones left with ab123456 and 12345678"
    rows = [(i % 5 if i % 7 else None, i // 9 if i % 11 else None, None if i % 13 == 5 else "" if i % 13 == 6 else "nothing here" if i % 13 == 7
             else text[: 20 + 3 * (i % 40)] + f" x{i % 4}@y.org", {"n": i}) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:40], "file long, seq long, text string, more map<string,long>").repartition(5)

    def run():
        r = jobs.mask(df, "text", ["seq"], ["file"], rules=load_rules())
        out = sorted(map(repr, r.masked.collect())), sorted(map(repr, r.registry.collect())), sorted(map(repr, r.mapping.collect()))
        return out, r.cached, (r.masked.dtypes, r.registry.dtypes), r.masked._jdf.queryExecution().optimizedPlan().toString()

    got, cached, types, plan = run()
    monkeypatch.setattr(jobs, "SCOPE_UNITS", 1)
    want, held, were, _ = run()
    assert got == want and types == were and held and not cached and "Join" not in plan and len(got[0]) == 340
    monkeypatch.setattr(jobs, "SCOPE_UNITS", 1000)
    monkeypatch.setattr(jobs, "SCOPE_CHARS", 1)
    assert run()[1]
