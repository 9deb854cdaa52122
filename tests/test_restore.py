"""Restore at size: one long text, every way of finding entries, any template."""

import os
import random
import re
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakline.operators import restore as ops
from cloakline.operators import rewriting
from cloakline.plans.jobs import mask, restore
from test_mask import rule


def in_turn(text, entries):
    for p, o in sorted(entries, key=lambda e: -len(e[0])):
        text = text.replace(p, o)
    return text


def random_case(rnd):
    letters = rnd.choice(["ab", "abc", "a", "abcdef", "é😀b"])
    word = lambda lo, hi, more="": "".join(rnd.choice(letters + more) for _ in range(rnd.randint(lo, hi)))
    entries = {word(1, 4): word(0, 4, "#") for _ in range(rnd.randint(1, 6))}
    return word(0, 25), list(entries.items())


def test_rewriting_equals_replacing_in_turn():
    rnd = random.Random(3)
    for _ in range(20_000):
        text, entries = random_case(rnd)
        assert rewriting.rewritten(text, sorted(entries, key=lambda e: -len(e[0]))) == in_turn(text, entries)


@pytest.mark.parametrize("way", ["own", "local", "tokens"])
def test_every_way_equals_replacing_in_turn(spark, monkeypatch, way):
    if way == "tokens":
        monkeypatch.setattr(ops, "LOCAL_ENTRIES", -1)
    rnd = random.Random(5)
    cases = [random_case(rnd) for _ in range(150)] + [("", [("a", "b")]), (None, [("a", "b")])]
    want = {i: None if t is None else in_turn(t, e) for i, (t, e) in enumerate(cases)}
    units = spark.createDataFrame([(i, 0, t) for i, (t, _) in enumerate(cases)], "f long, id long, text string")
    m = spark.createDataFrame([(i, p, o, k) for i, (_, e) in enumerate(cases) for k, (p, o) in enumerate(e)],
                              "f long, pseudonym string, original string, order int")
    keys = ["f", "id"] if way != "own" else ["f"]
    assert {r.f: r.text for r in restore(units, "text", keys, m, ["f"]).collect()} == want


def test_forty_thousand_values_in_one_text(spark):
    """Masked and restored without exchange of texts, far from quadratic."""
    rnd = random.Random(7)
    words = [f"u{i}@host{i % 97}.example" for i in range(40_000)]
    text = " ; ".join(words + rnd.sample(words, 5_000))
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id long, text string")
    r = mask(df, "text", ["id"], ["id"], rules=[rule("email", "P{n}@x.invalid", r"\bu[0-9]+@[a-z0-9.]+\b")])
    start = time.time()
    masked = r.masked.orderBy("id").collect()
    numbers = {}
    want = " ; ".join(f"P{numbers.setdefault(w, len(numbers) + 1)}@x.invalid" for w in text.split(" ; "))
    assert masked[0].text == want and masked[1].text == "none" and masked[2].text is None
    took = time.time() - start
    start = time.time()
    back = {x.id: x.text for x in restore(r.masked, "text", ["id"], r.mapping, ["id"]).collect()}
    assert back == {1: text, 2: "none", 3: None}
    assert took < 90 and time.time() - start < 180  # a quadratic form takes hours


def test_values_of_several_rules_are_numbered_within_the_row(spark):
    rules = [rule("a", "A{n}", r"\ba[0-9]+\b"), rule("b", "B{n}-{orig_len}", r"\bb[0-9]+ ?"), rule("a", "AA{n}", r"\bc[0-9]+\b")]
    text = "b2 c5 a1 b1 a9 c5 b2 a1 c7"  # rule "a" counts its two blocks together: a1, a9, then c5, c7
    df = spark.createDataFrame([(1, text), (2, "a4")], "id long, text string")
    out = dict(mask(df, "text", ["id"], ["id"], rules=rules).masked.collect())
    assert out == {1: "B1-3AA3 A1 B2-3A2 AA3 B1-3A1 AA4", 2: "A1"}
    exotic = [rule("a", "A{n:^5}", r"\ba[0-9]+\b")]  # rendered in Python, so not within the row
    assert mask(df, "text", ["id"], ["id"], rules=exotic).masked.where("id = 2").first()["text"] == "A  1  "


def test_single_pass_with_templates_that_copy_the_original(spark, monkeypatch):
    n = 10_000
    names = [f"n{i}x" for i in range(n)]
    m = spark.createDataFrame([(f"<{w}>", w, i) for i, w in enumerate(names)] + [("<n1x><n2x>", "both", n)],
                              "pseudonym string, original string, order int")
    assert ops.shapes(m.select("pseudonym", F.lit(0).alias("_scope")).where("length(pseudonym) < 99")) is not None
    texts = {i: f"a <{names[i]}> b <{names[-1 - i]}><zz> <n1x><n2x><n3x>" for i in range(0, n, 50)}
    df = spark.createDataFrame([*texts.items(), (-1, None), (-2, "")], "id long, text string")
    want = {i: t.replace("<n1x><n2x>", "both").replace(f"<{names[i]}>", names[i]).replace(f"<{names[-1 - i]}>", names[-1 - i])
            .replace("<n3x>", "n3x") for i, t in texts.items()} | {-1: None, -2: ""}
    monkeypatch.setattr(ops, "MAX_SHAPES", 2)
    assert ops.shapes(m) is None
    assert dict(restore(df, "text", ["id"], m, None, mode="single_pass").collect()) == want


def test_tokens_by_shape_do_not_grow_with_the_mapping(spark, monkeypatch):
    """A full hash table lets every substring through; shapes let only places with a shape through."""
    monkeypatch.setattr(ops, "FILTER_BITS", 10)
    rows = [(0, f"{i:07d}", f"v{i}", i) for i in range(1, 4001)] + [(0, f"p{i}@x", f"m{i}", 4000 + i) for i in range(1, 2000)]
    m = spark.createDataFrame(rows, "_scope int, pseudonym string, original string, order int")
    text = "Order 0000017 by p12@x login ab, é p1234@x and 00000012"
    words = {w for _, p, _, _ in rows for w in [p]}
    found = ops.finder(m).tokens(text)
    assert {(s, w) for w in words for s in range(len(text)) if text.startswith(w, s)} <= set(found)
    assert len(found) <= 6 < len(ops.pseudonym_filter(m).tokens(text))
    monkeypatch.setattr(ops, "LOCAL_ENTRIES", -1)
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    want = in_turn(text, [(p, o) for _, p, o, _ in rows])
    assert dict(restore(df, "text", ["id"], m.drop("_scope"), None).collect()) == {1: want, 2: None, 3: ""}


def test_single_pass_scans_a_text_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        n.add(1)
        return t

    m = spark.createDataFrame([("p1", "a", 0), ("p22", "b", 1)], "pseudonym string, original string, order int")
    df = spark.createDataFrame([(i, "p1 p22 p3" if i % 2 else "none") for i in range(100)], "id long, text string")
    back = restore(df.withColumn("text", counted("text")), "text", ["id"], m, None, mode="single_pass")
    assert {r.text for r in back.collect()} == {"a b p3", "none"}
    assert n.value <= 200  # for the tokens and for the result; three times before


def test_filter_never_drops_a_word():
    rnd = random.Random(9)
    words = list({"".join(rnd.choice("abc漢😀") for _ in range(rnd.randint(1, 6))) for _ in range(200)})
    for bits in (10, 16):
        table = [0] * 2 ** bits
        for s in rewriting.slots_of(words, bits).tolist():
            table[s] = 1
        packed = bytes(sum(table[8 * i + j] << j for j in range(8)) for i in range(2 ** bits // 8))
        f = rewriting.Filter(sorted({len(w) for w in words}), bits, np.frombuffer(packed, dtype="u1"))
        for _ in range(100):
            text = "".join(rnd.choice("abc漢😀") for _ in range(40))
            found = set(f.tokens(text))
            assert {(s, w) for w in words for s in range(40) if text.startswith(w, s)} <= found


@pytest.mark.parametrize("mode", ["sequential", "single_pass"])
def test_own_lists_few_and_many(spark, mode):
    """Every scope a unit: few entries stay in the JVM, many go to Python, same result;
    no entry, null text, null original, prefixes of one another."""
    rng = random.Random(3)
    texts, entries = {}, {}
    for i in range(60):
        n = 200 if i == 7 else rng.randrange(0, 9)
        entries[i] = [(p, rng.choice([None, "", "a1", "x12", "no 7"])) for p in sorted({rng.choice(["a", "x"]) + str(rng.randrange(1500)) for _ in range(n)})]
        texts[i] = None if i == 3 else "".join(rng.choice("ax0123456789 ") for _ in range(rng.randrange(0, 200)))
    units = spark.createDataFrame(list(texts.items()), "id int, text string")

    def expected(some):
        found = sorted({re.sub("[0-9]", "0", p) for i in some for p, _ in entries[i]}, key=lambda p: (-len(p), p))
        rx = re.compile("|".join(re.sub("0+", lambda z: f"[0-9]{{{len(z[0])}}}", s) for s in found))
        out = {}
        for i in some:
            t, known = texts[i], dict(entries[i])
            if t is not None and mode == "sequential":
                for p in sorted(known, key=lambda p: (-len(p), p)):
                    t = t.replace(p, known[p] or "")
            elif t is not None:
                def at(m):
                    p = next((m[0][:n] for n in range(len(m[0]), 0, -1) if m[0][:n] in known), "")
                    return (known[p] or "") + m[0][len(p):] if p else m[0]
                t = rx.sub(at, t)
            out[i] = t
        return out

    for some in (list(texts), [i for i in texts if i != 7]):
        rows = [(i, p, o, k) for i in some for k, (p, o) in enumerate(entries[i])]
        mapping = spark.createDataFrame(rows, "id int, pseudonym string, original string, `order` int")
        back = restore(units.where(F.col("id").isin(some)), "text", ["id"], mapping, ["id"], mode=mode)
        assert dict(back.collect()) == expected(some)
        python = "ArrowEvalPython" in back._jdf.queryExecution().toString()
        assert python == (7 in some)


def test_finder_reaches_workers_by_value(spark):
    """Workers need no copy of this package: what is broadcast is bytes, with the classes in them."""
    get = ops.shipped(rewriting.Shapes(["a0"]))
    data = next(c.cell_contents for c in get.__closure__ if hasattr(c.cell_contents, "value")).value
    code = f"import pickle; print(pickle.loads({data!r}).tokens('xa7'))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.strip() == "[(1, 'a7')]", out.stderr
    assert get().tokens("xa7") == [(1, "a7")]
