import random

import numpy as np
from corpus_fixtures import SF001, edge, none  # noqa: F401

from cloakline.llm import line_dedup, queries, simhash


def brute_groups(fps):
    fps = np.array(fps, dtype=np.int64).view(np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1:] ^ fps[i]) <= 2) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def naive_simhash(text):
    import xxhash

    w = [x for x in "".join(c.lower() if c < "\x7f" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    fp = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fp - (1 << 64) if fp >= 1 << 63 else fp


def test_fingerprints_and_groups(spark, edge, none):
    for data in (edge, spark.read.parquet(f"{SF001}/documents.parquet")):
        rows = data.select("doc_id", "text").collect()
        got = simhash.near_duplicate_groups(data).collect()
        fps = [naive_simhash(r.text) for r in rows]
        roots = brute_groups(fps)
        names = {}
        for r, g in zip(rows, roots):
            names[g] = min(x for x in (names.get(g), r.doc_id, 1 << 62) if x is not None)
        want = sorted((str(r.doc_id), f"{fp & (1 << 64) - 1:016x}", names[g] if names[g] < 1 << 62 else None)
                      for r, fp, g in zip(rows, fps, roots))
        assert want == sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got)
    assert simhash.near_duplicate_groups(none).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(set(brute_groups([naive_simhash(r.text) for r in edge.collect()])))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (1, 2, 3)) == [1]  # case does not count
    assert simhash.keep_one(none).count() == 0


def test_chains_and_large_buckets(spark, monkeypatch):
    """A long chain of 2-bit steps, a dense cluster and random fingerprints; with
    a small bucket limit the linear way must give the same components."""
    rnd = random.Random(1)
    fps, cur = [], 0x123456789ABCDEF0
    for _ in range(120):
        cur ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
        fps.append(cur)
    centre = rnd.getrandbits(64)
    fps += [centre ^ (1 << i) for i in range(64)] + [centre ^ (1 << i) ^ (1 << j) ^ (1 << k) for i, j, k in (rnd.sample(range(64), 3) for _ in range(200))]
    fps += [rnd.getrandbits(64) for _ in range(100)]
    fps = [f - (1 << 64) if f >= 1 << 63 else f for f in dict.fromkeys(fps)]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "_id long, _fp long")
    want = brute_groups(fps)
    for limit in (64, 2):
        monkeypatch.setattr(simhash, "BUCKET", limit)
        got = dict(simhash.groups(rows).collect())
        assert [got[f] for f in fps] == want


def naive_lines(rows, min_words=10):
    seen, out = {}, []
    units = []
    for doc, text in sorted(rows):
        at = 0
        for k, line in enumerate(text.split("\n")):
            norm = " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in line.lower()).split(" "))
            norm = " ".join(x for x in norm.split(" ") if x)
            if norm.count(" ") + 1 >= min_words:
                units.append((norm, doc, k, at, at + len(line)))
            at += len(line) + 1
    for norm, doc, k, a, b in units:
        if norm in seen:
            out.append((doc, k, a, b, seen[norm]))
        else:
            seen[norm] = doc
    return out


def naive_cleaned(rows, min_words=10, min_docs=3):
    """Texts without repeated lines and sentence runs, character by character."""
    import re

    def norm(x):
        return re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", x.lower()).strip(" ")

    def long(x):
        wide = sum("\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" for c in x)
        return len(x.split(" ")) >= min_words or wide >= 2 * min_words

    found = {}  # (kind, form) -> places in order
    for doc, text in sorted(rows):
        at = 0
        for line in text.split("\n"):
            form = norm(line) or line.strip()
            if form:
                kind = "line" if long(form) else "short"
                found.setdefault((kind, form), []).append((doc, at, at + len(line), 1))
                if kind == "line":
                    marks = [m.end() for m in re.finditer(r"[.!?\u2026]+[\"')\]\u201d\u2019]*\s+|[\u3002\uff01\uff1f]+[\u300d\u300f\u201d\u2019]*\s*", line)]
                    cuts = [0, *marks, len(line)]
                    sentences = [(a, b) for a, b in zip(cuts, cuts[1:]) if norm(line[a:b])]
                    for i in range(len(sentences)):
                        for j in range(i, len(sentences)):
                            run = " ".join(norm(line[a:b]) for a, b in sentences[i:j + 1])
                            if long(run):
                                found.setdefault(("run", run), []).append((doc, at + sentences[i][0], at + sentences[j][1], 0))
                                break
            at += len(line) + 1
    gone = {doc: set() for doc, _ in rows}
    for (kind, _), places in found.items():
        if kind != "short" or len({p[0] for p in places}) >= min_docs:
            for doc, a, b, end in places[1:]:
                gone[doc].update(range(a, b + end))
    return {doc: "".join(c for i, c in enumerate(text) if i not in gone[doc]) for doc, text in rows}


def test_cleaned_equals_the_plain_form(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = naive_cleaned(rows)
    got = queries.op8_line_dedup(spark, SF001).collect()
    before = dict(rows)
    assert len(got) == len(rows) and sum(len(t) for t in want.values()) < sum(len(t) for t in before.values())
    for r in got:
        assert (r.text or "") == want[r.doc_id] == "".join(before[r.doc_id][s.start:s.end] for s in r.kept_spans)


def test_line_dedup(spark, edge, none):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = line_dedup.removed_lines(docs).collect()
    assert sorted((r.doc_id, r.unit, r.start, r.end, r.first_doc_id) for r in got) == sorted(naive_lines(rows))
    spans = line_dedup.removed_lines(edge).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in spans) == [(2, 1), (2, 1), (3, 1)]
    out = line_dedup.cleaned(edge)
    assert out.columns == [*edge.columns, "kept_spans"] and out.count() == edge.count()
    before = {(r.doc_id, r.text) for r in edge.collect()}
    for r in out.collect():
        texts = [t for d, t in before if d == r.doc_id]
        assert any(r.text == (None if t is None else "".join(t[s.start:s.end] for s in r.kept_spans)) for t in texts)
    assert sum(r.text == "" for r in out.collect() if r.doc_id in (1, 2, 3)) == 3
    assert line_dedup.removed_lines(none).count() == 0 and line_dedup.cleaned(none).count() == 0


def test_short_and_unspaced_lines(spark):
    """A short line goes by its number of documents, a text without blanks by its characters."""
    zh = "\u8fd9\u662f\u4e00\u6bb5\u6ca1\u6709\u7a7a\u683c\u7684\u4e2d\u6587\u6587\u5b57" * 2
    rows = [(1, f"Read more here\nfirst\n{zh}"), (2, f"Read more here\ntwice\n{zh}"), (3, "Read more here\ntwice"), (4, "once\nonce\nonce")]
    out = line_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "twice\n", 3: "twice", 4: rows[3][1]}


def test_passages_inside_lines(spark):
    """A shared passage in the middle of lines that differ elsewhere, its short sentence too."""
    same = "The old mill by the river was sold last spring to a family from town. They came. Nobody in the village had seen the inside of it for twenty years."
    rows = [(1, f"One opens so. {same} One ends so."), (2, f"Two begins in another way! {same} Two ends in yet another way."), (3, "Nothing is shared here.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {(r.doc_id, r.first_doc_id, r.whole) for r in line_dedup.removed_passages(df).collect()} == {(2, 1, False)}
    out = {r.doc_id: r.text for r in line_dedup.cleaned(df).collect()}
    assert out == {1: rows[0][1], 2: "Two begins in another way! Two ends in yet another way.", 3: rows[2][1]}
    assert line_dedup.removed_lines(df).count() == 0


def test_rows_that_share_an_id_and_repeats_in_one_text(spark):
    """Of rows with one id (or none) the first read keeps; a unit counts once a text."""
    a, b = ("The committee met on a rainy evening to settle the long dispute over %s." % x for x in ("the bridge", "the mill"))
    rows = [(None, f"{a} x"), (5, f"{b}\n{a}\n{a}"), (5, f"{a}\n{b}"), (5, f"{a}\n{b}"), (None, f"{b}\n{b}")]
    want = {f"{a} x", f"{b}\n{a}\n"}
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for data, options in ((df, {}), (df.selectExpr("*", "7L f", "monotonically_increasing_id() r"), {"row_cols": ("f", "r")})):
        out = line_dedup.cleaned(data, **options)
        assert out.columns == [*data.columns, "kept_spans"] and out.count() == 5
        assert {r.text for r in out.collect()} - {"", "x"} == want - {f"{a} x"}
    got = line_dedup.removed_lines(df).collect()
    assert sorted((r.doc_id or 0, r.unit, r.first_doc_id, r.occurrences) for r in got) == [
        (0, 0, 5, 5), (0, 1, 5, 5), (5, 0, 5, 4), (5, 0, 5, 4), (5, 1, 5, 5), (5, 1, 5, 5), (5, 2, 5, 4)]
