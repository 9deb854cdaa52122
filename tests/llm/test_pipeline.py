from collections import Counter

import pytest
from corpus_fixtures import SF001, edge, none  # noqa: F401
from test_dedup import brute_groups, naive_simhash
from test_rules_mix_pii import base_spans, counts, fill
from test_tokens_packing import check_pack, plain  # noqa: F401

import corpus_pipeline
from cloakline.llm import pii, quality_rules
from cloakline.llm.common import written

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text or ""))


@pytest.mark.parametrize("source", ["table", "edge"])
def test_stages_against_brute_force(spark, edge, plain, source):
    docs = edge if source == "edge" else spark.read.parquet(f"{SF001}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mix", "pack"]
    out = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = written(stage(spark, out[list(out)[-1]], SF001), "test")
        if name != "pack":
            assert out[name].columns == docs.columns
    if source == "edge":  # quality leaves little of these: the other stages on all of them too
        for name in ("near_duplicates", "personal_data", "mix"):
            assert STAGES[name](spark, docs, SF001).columns == docs.columns

    good = rows_of(out["quality"])
    fail = Counter(r for r in docs.collect() if counts(r.text)[-1])
    assert not fail & Counter(good)
    judged = quality_rules.verdicts(docs)  # its counts and SQL have tests of their own
    assert len(good) == judged.where("kept").count()

    single = rows_of(out["near_duplicates"])
    groups = brute_groups([naive_simhash(r.text) for r in good])
    want = sorted(min(r.doc_id if r.doc_id is not None else 1 << 62 for r, x in zip(good, groups) if x == g) for g in set(groups))
    assert want == [r.doc_id if r.doc_id is not None else 1 << 62 for r in single] and not Counter(single) - Counter(good)

    clean = rows_of(out["personal_data"])
    spans = {(r.doc_id, len(r.base)): r.spans for r in pii.find(out["near_duplicates"]).collect()}
    assert len(clean) == len(single)
    for before, after in zip(single, sorted(clean, key=lambda r: (r.doc_id is None, r.doc_id))):
        at, parts = 0, []
        for s in spans[before.doc_id, len(base_spans(before.text))]:
            if s.s >= at:
                parts += [before.text[at:s.s], f"<{pii.KINDS[s.k].upper()}>"]
            at = max(at, s.e)
        assert after.text == "".join(parts) + before.text[at:] and after.n_chars == len(after.text)

    mixed = Counter(r.doc_id for r in out["mix"].collect())
    order = sorted({r.source for r in clean}, key=lambda s: (s is None, s))
    size = {r.doc_id: counts(r.text)[0] for r in clean}
    total = [sum(size[r.doc_id] for r in clean if r.source == s) for s in order]
    for s, target in zip(order, fill(total, [i % 3 + 1 for i in range(len(order))])):
        own = [r.doc_id for r in clean if r.source == s]
        assert all(mixed[d] <= 3 for d in own)
        assert abs(sum(mixed[d] * size[d] for d in own) - target) <= max(size[d] for d in own)
    texts = {r.doc_id: [] for r in out["mix"].collect()}
    for r in out["mix"].collect():
        texts[r.doc_id].append(r.text)
    check_pack(out["pack"].collect(), texts, plain)


def test_run_equals_the_stages_and_takes_empty_tables(spark, none):
    got = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.count() == 0
