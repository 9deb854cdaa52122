import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from corpus_fixtures import SF001, edge, none  # noqa: F401
from pyspark.sql import functions as F

from cloakline.llm import piece_codec, queries, spelling, turn_repair

WS = " \t\n\x0b\x0c\r"


# ---- op11 -----------------------------------------------------------------------------------------------------------

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def brute(rows):
    """All columns of one conversation, by a plain table of best (cost, audit, turns)."""
    rows, faults, seen = damage(rows), [], set()
    for _, role, text in rows:
        core = text.rstrip(WS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(4):  # inserts
            for s, (c, a, t) in list(best.items()):
                new = "a" if s == "u" else "u"
                cand = (c + 2, a + "I", (*t, {"u": "user:", "a": "assistant:"}[new]))
                best[new] = min(best.get(new, cand), cand)
        if i == len(rows):
            break
        after = {}
        for s, (c, a, t) in best.items():
            moves = [(s, (c + 3, a + "D", t))]
            if faults[i] not in ("blank", "duplicate"):
                extra = int(faults[i] == "truncated")
                if initials[i] and initials[i] in legal[s]:
                    moves.append((initials[i], (c + extra, a + "K", (*t, f"{rows[i][1]}:{rows[i][2]}"))))
                for new, role in (("u", "user"), ("a", "assistant")):
                    if new in legal[s]:
                        moves.append((new, (c + 2 + extra, a + "R", (*t, f"{role}:{rows[i][2]}"))))
            for state, cand in moves:
                after[state] = min(after.get(state, cand), cand)
        best = after
    cost, audit, turns = min(v for s, v in best.items() if s in ("", "a"))
    numbers = [r[0] for r in rows if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(turns).encode()).hexdigest())


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def compare(df, **options):
    groups = {}
    for r in df.select("conv_id", "turn", "role", "text").collect():
        groups.setdefault(r[0], []).append(tuple(r))
    got = {r[0]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repaired(turn_repair.damaged(df), **options).collect()}
    assert got == {k: brute(v) for k, v in groups.items()}
    return got


@pytest.fixture(scope="module")
def talks(spark):
    rnd = random.Random(11)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 40])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No", " \n", "", None, "Why?", f"Number {turn}.", f"open {rnd.random()}", "x!\t"])
            rows += [(conv, rnd.choice([turn, turn, turn, turn + 2, None]), role, text, 0, "r")] * rnd.choice([1, 1, 1, 1, 3])
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, later int, _c string").repartition(5)


def test_repair_equals_the_plain_table(spark, talks):
    assert None in compare(talks)


def test_repair_over_borders_of_segments_and_partitions(spark, talks):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        compare(talks, segment=3)
        compare(talks.withColumn("conv_id", F.lit(7)).withColumn("text", F.concat("text", F.col("turn").cast("string"))), segment=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_of_the_test_table(spark):
    df = spark.read.parquet(f"{SF001}/conversations.parquet")
    got = compare(df)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_conversation_repair(spark, SF001).collect()} == got
    assert turn_repair.repaired(turn_repair.damaged(df.where("conv_id < -1"))).count() == 0


def test_no_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert compare(df) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_bidirectional_search_equals_the_plain_table():
    rnd = random.Random(5)
    for _ in range(400):
        rows = [(rnd.choice("usatu"), False, rnd.choice([0, 0, 1]), 1) if rnd.random() < .8 else ("", True, 0, rnd.randint(1, 3))
                for _ in range(rnd.randint(0, 9))]
        best = {0: (0, "")}
        for i in range(len(rows) + 1):
            for _ in range(4):
                for s, (c, a) in list(best.items()):
                    t = turn_repair.WRITTEN[s]
                    best[t] = min(best.get(t, (99, "")), (c + 2, a + "I"))
            if i < len(rows):
                after = {}
                for s, (c, a) in best.items():
                    for w, p, t in turn_repair.steps(rows[i], s):
                        after[t] = min(after.get(t, (999, "")), (c + p, a + w))
                best = after
        want = min(v for s, v in best.items() if s in (0, 3))
        assert turn_repair.cheapest(rows, 0, (0, 3), True)[:2] == want


# ---- op12 -----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_path())


def test_ids_are_those_of_the_library(library):
    rnd = random.Random(2)
    c = piece_codec.Codec(piece_codec.default_path())
    bits = ["  ", " ", " ", "\n", "\t", "▁", "a", "b", "t", "he", "in", "er", "é", "漢", "字", "😀", "\x00", "ß", "1", "0", ".", "..", "<s>", "<0x0A>",
            "\r", "The", "́", "ﬁ"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += [" " * rnd.randint(0, 70) + "x" * rnd.randint(0, 40) + " " * rnd.randint(0, 40) for _ in range(300)]
    texts += ["", " ", "\n", "a" * 50_000, "漢字" * 20_000, " " * 20_000, "ab" * 30_000 + "\n" * 3_000]
    for _ in range(2):  # cold, then from what is kept
        assert [c.encode(t) for t in texts] == [library.encode(t) for t in texts]


def test_small_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE_PARTS", 20)
    c = piece_codec.Codec(piece_codec.default_path())
    rnd = random.Random(4)
    texts = [" ".join("".join(rnd.choice("abcdeé.") for _ in range(rnd.randint(1, 8))) for _ in range(30)) for _ in range(200)]
    assert [c.encode(t) for t in texts] == [library.encode(t) for t in texts]
    assert len(c.known) <= 30 + 10


def test_codec_query(spark, library, edge, none):  # noqa: F811
    texts = Counter((r.doc_id, r.text or "") for r in edge.collect())
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in piece_codec.encode_decode(edge).collect())
    assert got == Counter({(d, (*library.encode(t), 2), library.decode([*library.encode(t), 2])): n for (d, t), n in texts.items()})
    assert piece_codec.encode_decode(none).count() == 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = queries.op12_sentencepiece(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_codec_of_texts_in_several_groups(spark, library):  # noqa: F811
    rows = [(1, "a large text, in words. " * 90_000), (2, None), (3, "b\u00e9\n" * 700_000), (4, ""), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.ids, r.decoded) for r in piece_codec.encode_decode(df).collect()}
    for i, t in rows:
        ids = [*library.encode(t or ""), 2]
        assert got.pop(i) == (ids, library.decode(ids))
    assert not got


# ---- op13 -----------------------------------------------------------------------------------------------------------

def edits(word):
    """What one deletion of the word gives, and the words with one place open."""
    return {word[:i] + word[i + 1:] for i in range(len(word))}, {(i, word[:i] + word[i + 1:]) for i in range(len(word))}


def brute_variants(rows, damage=97, low=5, least=3):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= low:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= least}
    near = {w: set() for w in words}
    holes = {}
    for w in words:
        shorter, open_at = edits(w)
        for s in shorter & words.keys():
            near[w].add(s)
            near[s].add(w)
        for o in open_at:
            holes.setdefault(o, []).append(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return out


def rows_of(df):
    return [(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()]


def test_variants_of_random_words(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(5, 9))) for _ in range(60)]
    rows = []
    for doc in range(150):
        found = []
        for _ in range(60):
            w = rnd.choice(base[: rnd.randint(1, 60)])
            for _ in range(rnd.choice([0, 0, 1, 2])):
                i = rnd.randint(0, len(w))
                w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abZ") + w[i:], w[:i] + "b" + w[i + 1:]])
            found.append(w.upper() if rnd.random() < .2 else w)
        rows.append((doc if doc else None, rnd.choice([" ", "-", "×"]).join(found) if doc != 3 else None))
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    for damage in (97, 5, None):
        got = rows_of(spelling.variants(df, damage=damage))
        assert len(got) == len(set(got)) and set(got) == brute_variants(rows, damage)
    assert max(r[2] for r in got) > 5


def test_variants_query_and_edges(spark, edge, none):  # noqa: F811
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert set(rows_of(spelling.variants(edge))) == brute_variants(rows)
    assert spelling.variants(none).count() == 0
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = rows_of(queries.op13_spelling_variants(spark, SF001))
    assert len(got) == len(set(got)) and set(got) == brute_variants(docs)


def test_long_chains_of_forms(spark):
    words = ["stone" + "abcdefgh"[:k] for k in range(9)]
    text = " ".join(w for k, w in enumerate(words) for _ in range(3 * 2 ** (8 - k)))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = rows_of(spelling.variants(df, damage=None))
    assert set(got) == brute_variants([(1, text)], None) and {r[5] for r in got} == {"stone"}
