import zlib

import numpy as np
from corpus_fixtures import SF01, SF001, edge, none  # noqa: F401
from pyspark.sql import functions as F

from cloakline.llm import langid, permutation_index, quality_knn, queries


def crc_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def naive_kneser_ney(counts, order):
    """Interpolated Kneser-Ney by its definition, for one language."""
    levels, level = {}, dict(counts)
    for n in range(order, 0, -1):
        levels[n] = level
        lower = {}
        for g in level:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        level = lower

    def p(ctx, ch, n, alphabet):
        if n == 0:
            return 1 / (alphabet + 1)
        lv = levels[n]
        ones, twos = (sum(v == k for v in lv.values()) for k in (1, 2))
        d = min(max(ones / (ones + 2 * twos) if ones else 0.5, 0.1), 0.9)
        ctx = ctx[len(ctx) - n + 1:] if n > 1 else ""
        follow = {g: v for g, v in lv.items() if g[:-1] == ctx}
        if not follow:
            return p(ctx, ch, n - 1, alphabet)
        c = sum(follow.values())
        return max(follow.get(ctx + ch, 0) - d, 0) / c + d * len(follow) / c * p(ctx, ch, n - 1, alphabet)

    return p


def test_kneser_ney_equals_its_definition():
    from collections import Counter

    texts = {"aa": ["abab abba", "baab"], "bb": ["cdcd dccd", "dd cd"]}
    counts = {}
    for lang, ts in texts.items():
        cp, _ = langid.symbols(ts)
        s = "".join(map(chr, cp.tolist()))
        c = counts.setdefault(lang, Counter())
        for t in ts:
            cp, _ = langid.symbols([t])
            s = "".join(map(chr, cp.tolist()))
            c.update(s[i:i + langid.ORDER] for i in range(len(s) - langid.ORDER + 1))
    model = langid.fit(counts)
    alphabet = len({g[-1] for c in counts.values() for g in c})
    tests = ["abab", "dcx cd", "!!a"]
    got, chars = model.entropies(tests)
    for k, lang in enumerate(model.langs):
        p = naive_kneser_ney(counts[lang], langid.ORDER)
        for t, g, n in zip(tests, got, chars):
            cp, _ = langid.symbols([t])
            s = "".join(map(chr, cp.tolist()))
            want = -np.mean([np.log(p(s[i:i + 3], s[i + 3], langid.ORDER, alphabet)) for i in range(len(s) - 3)])
            assert n == len(s) - 3 and abs(want - g[k]) < 1e-9
    # the result of a text does not depend on its neighbours
    assert np.allclose(model.entropies(["abab"])[0], got[0])
    assert (np.diff(model.grams[3].astype(np.uint64)) > 0).all()


def test_language_query(spark, edge, none):
    rows = {r.doc_id: r for r in queries.op1_language_id(spark, SF01).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    assert rows.keys() == docs.keys() and all(r.held_out == crc_held_out(i) and 0 <= r.score <= 1 for i, r in rows.items())
    test = [i for i in rows if rows[i].held_out]
    assert np.mean([rows[i].lang_pred == docs[i].lang for i in test]) > 0.96
    model = langid.learn(spark.read.parquet(f"{SF001}/documents.parquet"))
    found = langid.identify(edge, model, reject=False).collect()
    letters = [(r.doc_id, r.text) for r in edge.collect()]
    und = [r for r in found if r.lang_pred == "und"]
    assert len(und) == sum(not any(c.isalpha() for c in t or "") for _, t in letters) and all(r.score == 0 for r in und)
    strict = langid.identify(edge, model).collect()
    assert all(r.accepted or r.lang_pred == "und" for r in strict)
    assert langid.identify(none, model).count() == 0 and langid.learn(none) is None
    assert {r.lang_pred for r in langid.identify(edge, None).collect()} == {"und"}


def test_quality_query(spark, edge, none):
    rows = {r.doc_id: r for r in queries.op9_quality_knn(spark, SF01).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == crc_held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in rows.items())
    test = [i for i in labels if crc_held_out(i)]
    assert np.mean([rows[i].predicted == labels[i] for i in test]) > 0.93
    docs, known = spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/labels.parquet")
    model = quality_knn.learn(docs, known)
    got = quality_knn.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_knn.score(none, model).count() == 0
    assert {r.score for r in quality_knn.score(edge, quality_knn.learn(docs, known.where("false"))).collect()} == {quality_knn.PRIOR}


def test_knn_votes_equal_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "###", "x|y", "DELTA"], 30)) for _ in range(80)]
    y = rng.integers(0, 2, 60)
    model = quality_knn.fit(quality_knn.term_counts(texts[:60]), y)
    z = quality_knn._unit(quality_knn._weigh(quality_knn.term_counts(texts[60:]), model.idf) @ model.basis)
    for got, v in zip(model.scores(texts[60:]), z):
        s = model.vectors @ v
        near = np.argsort(-s, kind="stable")[:quality_knn.NEIGHBOURS]
        w = np.maximum(s[near], 0).astype(float) ** quality_knn.POWER
        assert abs(got - (w * y[near]).sum() / w.sum()) < 1e-4


def nearest_by_force(rows, queries_, k):
    x = np.array([r[1] for r in rows], dtype=np.float64)
    ids = np.array([r[0] for r in rows])
    for q in queries_:
        s = permutation_index.cosines(x, x[q])
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        yield ids[q], [(int(ids[j]), float(s[j])) for j in order]


def test_permutation_index_recall_and_scores(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got = {}
    for r in queries.op7_permutation_index(spark, SF01).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits, asked = 0, [i for i, r in enumerate(rows) if r[0] % 50 == 0]
    for q, want in nearest_by_force(rows, asked, 5):
        hits += len({v for v, _ in want} & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(a[1] >= b[1] for a, b in zip(got[q], got[q][1:]))
        exact = dict(want)
        assert all(abs(exact[v] - s) < 1e-12 for v, s in got[q] if v in exact)
    assert hits >= 0.9 * 5 * len(asked)


def test_permutation_index_edges(spark):
    schema = "vec_id long, embedding array<float>, rank int, row string"
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=8)], 0, "x") for i in range(30)]
    rows += [(100 + i, rows[0][1], 0, "x") for i in range(40)]  # copies of one vector: ties
    rows += [(200, None, 0, "x"), (201, [0.0] * 8, 0, "x"), (202, [None] + [1.0] * 7, 0, "x"), (203, [float("nan")] * 8, 0, "x"), (204, [1.0, 2.0], 0, "x"), (205, [], 0, "x")]
    df = spark.createDataFrame(rows, schema).repartition(4)
    out = permutation_index.nearest(df, F.col("vec_id") % 10 == 0).collect()
    assert {r.query_id for r in out} == {r[0] for r in rows[:70] if r[0] % 10 == 0}
    first = sorted((r["rank"], r.vec_id) for r in out if r.query_id == 0)
    assert first == [(1, 100), (2, 101), (3, 102), (4, 103), (5, 104)]
    tiny = permutation_index.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in tiny) == [1, 2]
    assert permutation_index.nearest(df.where("vec_id = 5"), F.lit(True)).count() == 0
    assert permutation_index.nearest(df.where("false"), F.lit(True)).count() == 0


def test_language_of_long_texts_or_one_text_is_learned(spark):
    en, de, fr = "the garden and the house are near the river ", "der Garten und das Haus sind nahe am Fluss ", "le jardin et la maison sont pr\u00e8s du fleuve "
    rows = [(i, en * 40, "en") for i in range(40)] + [(100 + i, de * 600, "de") for i in range(40)] + [(200, fr * 40, "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    found = {r.id: r.lang_pred for r in langid.identify(df.select("doc_id", "text"), model, reject=False).collect()}
    assert found == {r[0]: r[2] for r in rows}


def test_language_of_texts_in_several_groups(spark):
    en, de = "the garden and the house are near the river ", "der Garten und das Haus sind nahe am Fluss "
    model = langid.learn(spark.createDataFrame([(i, (de if i % 2 else en) * 40, "de" if i % 2 else "en") for i in range(40)],
                                               "doc_id long, text string, lang string"))
    rows = [(1, en * 15_000), (2, de * 15_000), (3, None), (4, de), (5, en * 30_000), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.id: r.lang_pred for r in langid.identify(df, model, reject=False).collect()}
    assert found == {1: "en", 2: "de", 3: "und", 4: "de", 5: "en", 6: "und"}


def test_quality_of_texts_in_several_groups(spark):
    good, bad = "alpha beta gamma delta words that read well ", "### x|y 000 ### "
    rows = [(i, (bad if i % 2 else good) * (20_000 if i < 4 else 30)) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_knn.learn(df, labels)
    assert len(model.labels) == 40
    found = {r.id: r.score for r in quality_knn.score(df, model).collect()}
    assert found.keys() == {r[0] for r in rows} and all((found[i] > 0.5) == (i % 2 == 1) for i in range(40))
