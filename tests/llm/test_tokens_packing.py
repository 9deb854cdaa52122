import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pytest
from corpus_fixtures import SF001, edge, none  # noqa: F401
from pyspark.sql import functions as F

from cloakline.llm import packing, queries, token_files, tokens


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_path())
    return lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids, dtype="<u4")


def test_parts_give_the_ids_of_the_whole(plain):
    rnd = random.Random(3)
    chars = " \n\t \u0085\x1ca'sB1.é漢😀-"
    texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["", " ", "a ", " a", "a   b \n  c"]
    enc = tokens.Encoder(tokens.default_path())
    for _ in range(2):  # cold, then from the cache
        assert all(x == plain(t).tobytes() for x, t in zip(enc.encode(texts), texts))


def naive_sum_of_squares(lengths, size):
    gaps, used = [], []
    for s in lengths:
        best = None
        for b in [*range(len(gaps)), len(gaps)]:
            if b < len(gaps) and gaps[b] < s:
                continue
            after = gaps[:b] + [(gaps[b] if b < len(gaps) else size) - s] + gaps[b + 1:]
            counts = np.bincount([g for g in after if 0 < g], minlength=1)
            cost = int((counts.astype(np.int64) ** 2).sum())
            gap = gaps[b] if b < len(gaps) else size
            if best is None or (cost, gap) < best[:2]:
                best = (cost, gap, b)
        b = best[2]
        if b == len(gaps):
            gaps.append(size)
        gaps[b] -= s
        used.append(best[0])
    return len(gaps), used


def test_sum_of_squares_rule():
    rnd = random.Random(5)
    for size in (7, 16):
        for _ in range(30):
            lengths = [rnd.randint(1, size) for _ in range(25)]
            seq, off, n = packing.sum_of_squares(np.array(lengths), size)
            want, costs = naive_sum_of_squares(lengths, size)
            assert n == want == len(set(seq))
            fill, got = {}, []
            for s, b, o in zip(lengths, seq, off):
                assert fill.get(b, 0) == o
                fill[b] = o + s
                counts = np.bincount([size - f for f in fill.values() if f < size], minlength=1)
                got.append(int((counts ** 2).sum()))
            assert got == costs and max(fill.values()) <= size


def test_joined_words_fall_back_for_other_vocabularies(plain, monkeypatch):
    """Where no token starts with the blank, new words are encoded one by one; short inputs split as long ones do."""
    texts = ["one two\u00a0three  four \u0120five six\n seven", " lead and trail ", "", "\u0120 \u0120\u0120 a", "x" * 5000 + " y" * 3000]
    for joined in (1, 2, 1000):
        monkeypatch.setattr(tokens, "JOINED_WORDS", joined)
        enc = tokens.Encoder(tokens.default_path())
        assert enc.encode(texts) == [plain(t).tobytes() for t in texts]
        enc = tokens.Encoder(tokens.default_path())
        enc.starts[:] = False
        assert enc.encode(texts) == [plain(t).tobytes() for t in texts]


def test_cuts_at_line_feeds_and_signs_give_the_ids_of_the_whole(plain, monkeypatch):
    """Signs, digits, line feeds and rare white space next to letters of one, two and three bytes, kept parts and given up ones."""
    rnd = random.Random(11)
    chars = " \n\r\t\x1c\u0085\u00a0\u2003\u3000\u2014\u201c\u3001\u1681\u00bf\u00aa\u00d7\u00f7,.'!1$[sStlreZ\u00e9\u00ff\u0100\u0120\u010a\u6f22\u0301\U0001f600"
    for keep in (1_000_000, 200):
        monkeypatch.setattr(tokens, "CACHE_ENTRIES", keep)
        enc = tokens.Encoder(tokens.default_path())
        for _ in range(4):
            texts = ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
            assert enc.encode(texts) == [plain(t).tobytes() for t in texts]
    monkeypatch.setattr(tokens, "_plain_byte_level", lambda tok: False)  # files of another kind: cut before blanks alone
    assert tokens.Encoder(tokens.default_path()).encode(texts) == [plain(t).tobytes() for t in texts]


def test_a_word_is_encoded_once_whatever_sign_follows(plain):
    words = ["".join(chr(97 + (7 * i + i // 26 * j) % 26) for j in range(9)) + "\u00e9"[:i % 2] for i in range(300)]
    texts = [" ".join(["x", *[w + after + "x" for w in words]]) for after in (" ", ", ", ". ", "! ", "###\n", ".\n", "123 ", "\n")]
    enc = tokens.Encoder(tokens.default_path())

    class Counted:
        chars = 0

        def __init__(self, tok):
            self.tok = tok

        def encode_batch_fast(self, parts, **options):
            Counted.chars += sum(map(len, parts))
            return self.tok.encode_batch_fast(parts, **options)

    enc.tok, enc.spelled = Counted(enc.tok), Counted(enc.spelled)
    assert enc.encode(texts) == [plain(t).tobytes() for t in texts]
    assert Counted.chars < 1.5 * len(texts[0])


def test_groups_join_small_batches_and_split_large_ones():
    texts = ["ab", None, "c" * 30, "", "\u00e9" * 3, "d", None]
    for rows in (1, 2, 7):
        batches = pa.table({"id": range(7), "text": pa.array(texts)}).to_batches(rows)
        got = list(tokens.groups(iter([*batches, batches[0].slice(0, 0)]), 8))
        assert [k.to_pylist() for k, _ in got] == [[0, 1, 2], [3, 4, 5, 6]]
        assert [t for _, ts in got for t in ts.to_pylist()] == texts
    enc = tokens.Encoder(tokens.default_path())
    ids, at = enc.encode_array(pa.array(texts).slice(1, 5), b"\7\0\0\0")
    assert [ids[a:b].tobytes() for a, b in zip(at, at[1:])] == [x + b"\7\0\0\0" for x in enc.encode([t or "" for t in texts[1:6]])]
    assert list(tokens.groups(iter([]))) == [] and enc.encode([]) == []


def test_ranges_hold_every_text_once():
    texts = ["ab", None, "c" * 30, "", "\u00e9" * 3, "d", None]
    assert list(tokens.ranges(texts, 8)) == [(0, 3), (3, 7)]
    assert list(tokens.ranges(texts, 1)) == [(0, 1), (1, 3), (3, 5), (5, 6), (6, 7)]
    assert list(tokens.ranges([])) == [] and list(tokens.ranges([None])) == [(0, 1)]


def check_pack(rows, texts, plain, size=1024):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in by_seq.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= size
    for doc, ts in texts.items():
        want = []
        for t in ts:
            ids = np.append(plain(t), np.uint32(2))
            first = (len(ids) - 1) % size + 1
            cuts = [0, *range(first, len(ids) + 1, size)]
            want += [(i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted(want) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc])
    return len(by_seq)


def by_id(df):
    out = {}
    for r in df.select("doc_id", "text").collect():
        out.setdefault(r.doc_id, []).append(r.text)
    return out


def test_pack_edge_and_test_table(spark, edge, none, plain):
    rows = packing.pack(edge, carry=[F.crc32("ids").alias("ids_crc32")]).collect()
    check_pack(rows, by_id(edge), plain)
    assert packing.pack(none).count() == 0
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = queries.op2_best_fit_packing(spark, SF001).collect()
    n = check_pack(rows, by_id(docs), plain)
    assert n <= 1.05 * -(-sum(r.length for r in rows) // 1024)
    with_ids = packing.pack(edge, block_rows=4)  # several blocks: still whole
    check_pack(with_ids.withColumn("ids_crc32", F.crc32("ids")).collect(), by_id(edge), plain)


def test_token_files_round_trip(spark, edge, none, plain, tmp_path):
    path = str(tmp_path / "t")
    token_files.write_token_files(edge, path, end_id=0, file_bytes=100_000)
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    texts, at = by_id(edge), 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        assert any(r.ids == [*plain(t).tolist(), 0] for t in texts[r.doc_id])
        at += r.n_tokens
    assert len(rows) == edge.count()
    frag = next(f for f in ds.dataset(path).get_fragments() if f.metadata.num_rows)
    chunk = frag.metadata.row_group(0).column(4)
    assert chunk.path_in_schema.startswith("ids.") and "RLE_DICTIONARY" in chunk.encodings and chunk.has_column_index
    empty = str(tmp_path / "e")
    token_files.write_token_files(none, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_token_query(spark, plain):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").collect()
    rows = sorted(queries.op5_token_files(spark, SF001).collect(), key=lambda r: r.start)
    at = 0
    for d, r in zip(docs, rows, strict=True):
        ids = np.append(plain(d.text), np.uint32(0)).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
