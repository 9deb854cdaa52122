"""Unit shapes, split names, entities, restore, mapping documents, paths and
streaming."""

import json
import os
import tempfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cloakline.operators.names import component_words, sheet_units
from cloakline.plans.jobs import mask, mask_table, restore, restore_text_files
from cloakline.rules import load_rules, rule
from cloakline.sources.mapping_io import MASKED_FIELD, MASKED_STEM, mapping_documents, mask_paths, read_mapping, restore_paths
from cloakline.sources.units import line_units, page_text, paragraph_units, paragraph_write_back
from test_mask import ALL, EMAIL, NAME


# ── S5: paragraph runs ───────────────────────────────────────────────────────

def test_runs_merged_and_written_back(spark):
    runs = spark.createDataFrame([(1, 0, "John "), (1, 1, "Smith"), (1, 2, " signed"),
                                  (2, 0, "nothing "), (2, 1, "here")], "para long, run int, text string")
    paras = paragraph_units(runs, ["para"], "run", "text")
    red = mask(paras, "text", ["para"], None, rules=[NAME]).masked
    out = {(p, r): t for p, r, t in paragraph_write_back(runs, paras, red, ["para"], "run", "text").select(
        "para", "run", "text").collect()}
    assert out[(1, 0)] == "Person001 signed" and out[(1, 1)] == "" and out[(1, 2)] == ""
    assert out[(2, 0)] == "nothing " and out[(2, 1)] == "here"


# ── S9: pages ────────────────────────────────────────────────────────────────

def test_pages_lines_and_headings(spark):
    pages = spark.createDataFrame([("f", 1, "Mail a@x.com\nsecond line"), ("f", 2, None), ("f", 3, "b@x.com\r\n")],
                                  "file string, page int, text string")
    lines = line_units(pages, ["file"], "page", "text")
    red = mask(lines, "text", ["page_no", "line_no"], ["file"], rules=[EMAIL]).masked
    text = page_text(red, pages.select("file", F.col("page").alias("page_no")), ["file"]).first()["text"]
    assert text == ("--- Page 1 ---\nMail person001@anon.invalid\nsecond line\n\n"
                    "--- Page 2 ---\n\n\n--- Page 3 ---\nperson002@anon.invalid")


# ── S8 / M1-M6: sheets ───────────────────────────────────────────────────────

def _split_sheet(spark):
    return spark.createDataFrame([(1, "Alice", "Johnson", "alice.johnson@uni.ac.uk", 3.14),
                                  (2, "Bob", "Smith", "b.smith@uni.ac.uk", 42.0)],
                                 "row long, `First Name` string, `Last Name` string, Email string, Score double")


def test_string_cells_masked_numbers_untouched(spark):
    r = mask_table(_split_sheet(spark), "row", rules=ALL)
    rows = {x["row"]: x for x in r.masked.collect()}
    assert rows[1]["Email"].endswith("@anon.invalid") and rows[1]["Score"] == 3.14
    assert rows[2]["First Name"] == "Bob"  # a single word is not a name without the pre-scan


def test_multi_col_names_each_cell_restorable(spark):
    r = mask_table(_split_sheet(spark), "row", rules=[NAME], multi_col_names=True)
    rows = {x["row"]: x for x in r.masked.collect()}
    mapping = dict(r.mapping.select("pseudonym", "original").collect())
    for row, first, last in ((1, "Alice", "Johnson"), (2, "Bob", "Smith")):
        f, la = rows[row]["First Name"], rows[row]["Last Name"]
        assert f.startswith("Person") and la.startswith("Person") and f != la
        assert mapping[f] == first and mapping[la] == last


def test_component_words(spark):
    keys = spark.createDataFrame([(0, "name", "Alice Johnson"), (0, "name", "Alice Brown"), (0, "name", "Alice"),
                                  (0, "name", "Dr O'Neil-Smith"), (0, "name", "Smith Jones")],
                                 "_scope int, rule string, key string")
    words = {w for _, w in component_words(keys, [NAME]).collect()}
    assert "Alice" not in words and {"Johnson", "Brown", "Dr", "O'Neil-Smith", "Jones"} <= words
    assert "Smith" not in words  # also hit inside O'Neil-Smith on a word boundary


# ── D2/D3, D12 ───────────────────────────────────────────────────────────────

def test_entities_replace_regex_for_entity_rules(spark):
    name = rule("name", "Person{n:03d}", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", spacy_ner=True,
                exclusions=["January"], min_word_length=2)
    df = spark.createDataFrame([(1, "Met Alice Smith in Paris on January First")], "id long, text string")
    ents = spark.createDataFrame([(1, 4, 15, "PERSON"), (1, 19, 24, "GPE"), (1, 28, 41, "PERSON")],
                                 "id long, s int, e int, label string")
    with_ents = mask(df, "text", ["id"], None, rules=[name], entities=ents).masked.first()["text"]
    assert with_ents == "Met Person001 in Paris on January First"
    no_ents = mask(df, "text", ["id"], None, rules=[name], entities=ents, use_entities=False).masked
    # regex fallback: leftmost "Met Alice" wins, "January First" is excluded
    assert no_ents.first()["text"] == "Person001 Smith in Paris on January First"


def test_proper_noun_flag(spark):
    df = spark.createDataFrame([(1, "Google hired Alice Smith")], "id long, text string")
    off = mask(df, "text", ["id"], None).masked.first()["text"]
    on = mask(df, "text", ["id"], None, proper_nouns=True).masked.first()["text"]
    assert off == "Google hired Person001" and on == "Entity001 hired Person001"


# ── T1-T5 ────────────────────────────────────────────────────────────────────

MAPPING = {"Person007": "Ada Vogel", "person007@anon.invalid": "ada@post.example.org", "0000031": "7000001",
           "user0002xx": "qz81kk02"}


@pytest.mark.parametrize("mode", ["sequential", "single_pass"])
def test_restore_cases(spark, mode):
    cases = {"seen by Person007 (0000031)": "seen by Ada Vogel (7000001)", "<person007@anon.invalid>": "<ada@post.example.org>",
             "user0002xx/user0002xx": "qz81kk02/qz81kk02", "": "", "as it was": "as it was"}
    units = spark.createDataFrame([(i, t) for i, t in enumerate([*cases, None])], "id long, text string")
    m = spark.createDataFrame([(p, o, i) for i, (p, o) in enumerate(MAPPING.items())],
                              "pseudonym string, original string, order int")
    out = dict(restore(units, "text", ["id"], m, None, mode=mode).collect())
    assert [out[i] for i in range(len(out))] == [*cases.values(), None]


def test_longer_pseudonyms_go_first(spark):
    units = spark.createDataFrame([(1, "K1 K12 K123 K1234")], "id long, text string")
    m = spark.createDataFrame([("K1", "a", 0), ("K123", "c", 1), ("K12", "b", 2)], "pseudonym string, original string, order int")
    assert restore(units, "text", ["id"], m).first()["text"] == "a b c c4"


def test_restore_text_files(spark):
    d = tempfile.mkdtemp(prefix="cl-test-files-", dir=os.environ.get("TMPDIR", "/tmp"))
    for name, body in (("a-masked.txt", "Dear Person007,\nsee person007@anon.invalid"), ("b-masked.txt", "x")):
        with open(os.path.join(d, name), "w") as fh:
            fh.write(body)
    files = spark.read.text(d, wholetext=True).select(F.input_file_name().alias("file")).collect()
    m = spark.createDataFrame([(f["file"], p, o, i) for f in files for i, (p, o) in enumerate(MAPPING.items())],
                              "file string, pseudonym string, original string, order int")
    out = {os.path.basename(f): t for f, t in restore_text_files(spark, d, m).collect()}
    assert out["a-masked.txt"] == "Dear Ada Vogel,\nsee ada@post.example.org" and out["b-masked.txt"] == "x"


# ── S10-S12 ──────────────────────────────────────────────────────────────────

def test_mapping_document_round_trip(spark):
    df = spark.createDataFrame([(1, "a@x.com and John Smith"), (2, "none")], "id long, text string")
    r = mask(df, "text", ["id"], ["id"], rules=ALL)
    files = spark.createDataFrame([(1, "/d/r.docx", "/d/r-masked.docx")], "id long, source_file string, masked_file string")
    docs = mapping_documents(r.registry, ["id"], files)
    doc = json.loads(docs.where("id = 1").first()["json"])
    assert doc["mapping"] == {"person001@anon.invalid": "a@x.com", "Person001": "John Smith"}
    assert doc["stats"] == {"email": 1, "name": 1} and doc["source_file"] == "/d/r.docx"
    assert list(doc) == ["source_file", MASKED_FIELD, "created", "spacy_ner_used", "stats", "mapping"]
    back = read_mapping(docs, ["id"]).collect()
    assert {(x["pseudonym"], x["original"]) for x in back} == {("person001@anon.invalid", "a@x.com"),
                                                                ("Person001", "John Smith")}
    every = mapping_documents(r.registry, ["id"], scopes=df.select("id"))
    assert json.loads(every.where("id = 2").first()["json"])["mapping"] == {}
    empty = spark.createDataFrame([(9, '{"mapping": {}}')], "id long, json string")
    with pytest.raises(ValueError):
        restore(df, "text", ["id"], read_mapping(empty, ["id"]), ["id"])


def test_paths(spark):
    df = spark.createDataFrame([("/x/report.docx", None), ("/x/notes.PDF", None), ("/x/data.csv", None),
                                (f"/x/report{MASKED_STEM}.docx", "/k/m.json")], "p string, m string")
    rows = df.select(mask_paths(F.col("p")).alias("r"), restore_paths(F.col("p"), mapping=F.col("m")).alias("b")
                     ).collect()
    assert rows[0]["r"]["masked"] == f"/x/report{MASKED_STEM}.docx" and rows[0]["r"]["mapping"] == "/x/report_mapping.json"
    assert rows[1]["r"]["masked"] == f"/x/notes{MASKED_STEM}.txt"
    assert not rows[2]["r"]["supported"] and not rows[2]["b"]["supported"]
    assert rows[3]["b"]["restored"] == f"/x/report{MASKED_STEM}_restored.docx" and rows[3]["b"]["mapping"] == "/k/m.json"
    assert rows[0]["b"]["mapping"] == "/x/report_mapping.json"


# ── R9: incremental and streaming ────────────────────────────────────────────

def test_incremental_equals_one_pass(spark):
    texts = ["a@x.com 1234567", "b@x.com a@x.com", "7654321 c@x.com 1234567", "b@x.com d@x.com"]
    df = spark.createDataFrame([(i, i // 2, t) for i, t in enumerate(texts)], "seq long, batch int, text string")
    df = df.withColumn("_ord", F.struct("batch", "seq"))
    one = mask(df, "text", ["seq"], None, rules=ALL, order_col="_ord")
    first = mask(df.where("batch = 0"), "text", ["seq"], None, rules=ALL, order_col="_ord")
    second = mask(df.where("batch = 1"), "text", ["seq"], None, rules=ALL, order_col="_ord", prior=first)
    cols = ["rule", "original", "n", "pseudonym"]
    assert sorted(map(tuple, one.registry.select(cols).collect())) == sorted(map(tuple, second.registry.select(cols).collect()))
    assert second.masked.orderBy("seq").first()["text"] == "0000002 person003@anon.invalid 0000001"


def test_streaming_batches_continue_registry(spark):
    from cloakline.streaming import incremental

    base = tempfile.mkdtemp(prefix="cl-test-stream-", dir=os.environ.get("TMPDIR", "/tmp"))
    schema = "seq long, text string"
    for i, rows in enumerate([[(0, "no hit")], [(1, "a@x.com"), (2, "b@x.com")], [(3, "b@x.com c@x.com")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/src/part{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{base}/src")
    q = incremental.start(stream, "text", ["seq"], ALL, state_dir=f"{base}/state")
    q.awaitTermination()
    reg = incremental.latest_registry(spark, f"{base}/state", spark.createDataFrame([], schema), ["seq"])
    got = dict(reg.select("key", "pseudonym").collect())
    assert got == {"a@x.com": "person001@anon.invalid", "b@x.com": "person002@anon.invalid",
                   "c@x.com": "person003@anon.invalid"}


def test_stream_state_is_read_by_key(spark):
    """A batch opens the buckets of its own values only; a replay changes nothing."""
    from cloakline.streaming import incremental

    base = tempfile.mkdtemp(prefix="cl-test-keyed-", dir=os.environ.get("TMPDIR", "/tmp"))
    first = spark.createDataFrame([(i, f"u{i}@x.com") for i in range(300)], "seq long, text string")
    second = spark.createDataFrame([(300, "u7@x.com new@x.com"), (301, "u299@x.com")], "seq long, text string")
    incremental.mask_batch(first, 0, base, "text", ["seq"], [EMAIL], buckets=256)
    for _ in range(2):
        incremental.mask_batch(second, 1, base, "text", ["seq"], [EMAIL], buckets=256)
        got = dict(spark.read.parquet(f"{base}/masked/batch=1").collect())
        assert got == {300: "person008@anon.invalid person301@anon.invalid", 301: "person300@anon.invalid"}
        assert incremental.latest_registry(spark, base, first, ["seq"]).count() == 301
    seen = spark.createDataFrame([(("u7@x.com"), "email")], "key string, rule string")
    old = incremental.keyed_prior(spark, base, 1, 256).lookup(seen)
    filters = old._jdf.queryExecution().executedPlan().toString().split("PartitionFilters:")[1].split("]")[0]
    assert "bucket" in filters and old.where("key = 'u7@x.com'").count() == 1 and old.count() < 30


def test_kind_dispatch(spark):
    from cloakline.plans.jobs import mask_kind

    df = spark.createDataFrame([(1, "a@x.com")], "id long, text string")
    assert mask_kind(df, "text", text_col="text", key_cols=["id"], rules=ALL).masked.first()["text"] \
        == "person001@anon.invalid"
    out, _ = mask_kind(df, "lines", file_cols=["id"], page_col=None, text_col="text", rules=ALL)
    assert out.first()["text"] == "--- Page 1 ---\nperson001@anon.invalid"
    with pytest.raises(ValueError):
        mask_kind(df, "docx")


def test_workbook_sheets_share_registry(spark):
    from cloakline.plans.jobs import mask_workbook

    s1 = spark.createDataFrame([(1, "Alice", "Johnson", "a@x.com")],
                               "row long, `First Name` string, `Last Name` string, Email string")
    s2 = spark.createDataFrame([(1, "Johnson", "a@x.com b@x.com")], "row long, Who string, Email string")
    t1, t2 = mask_workbook([(s1, "row"), (s2, "row")], rules=[EMAIL, NAME], multi_col_names=True)
    r2 = t2.masked.first()
    assert r2["Email"] == "person001@anon.invalid person002@anon.invalid"
    m = dict(t2.mapping.select("pseudonym", "original").collect())
    # "Johnson" is a component of "Alice Johnson" registered by sheet 1
    assert r2["Who"].startswith("Person") and m[r2["Who"]] == "Johnson"
    assert m[t1.masked.first()["Last Name"]] == "Johnson"


def test_collisions_and_last_registered_wins(spark):
    from cloakline.operators import registry as reg

    a = rule("id", "X{n}", r"\b\d{7}\b")
    b = rule("code", "X{n}", r"\b[a-z]{3}\d{3}\b")
    df = spark.createDataFrame([(1, "1234567 abc123")], "id long, text string")
    r = mask(df, "text", ["id"], None, rules=[a, b])
    assert r.masked.first()["text"] == "X1 X1"
    coll = reg.collisions(r.registry.withColumnRenamed("original", "key").withColumn("_scope", F.lit(0))).collect()
    assert [(c["pseudonym"], c["n_values"]) for c in coll] == [("X1", 2)]
    # the mapping keeps the value registered last (it cannot be reversed exactly)
    assert dict(r.mapping.select("pseudonym", "original").collect()) == {"X1": "abc123"}


def test_sequential_restore_rewrites_twice_single_pass_does_not(spark):
    df = spark.createDataFrame([(1, "7654321 then 90000001")], "id long, text string")
    idr = rule("id", "preserve_length", r"\b\d{7,8}\b")
    r = mask(df, "text", ["id"], ["id"], rules=[idr])
    assert r.masked.first()["text"] == "0000001 then 00000002"
    seq = restore(r.masked, "text", ["id"], r.mapping, ["id"]).first()["text"]
    one = restore(r.masked, "text", ["id"], r.mapping, ["id"], mode="single_pass").first()["text"]
    assert seq == "7654321 then 97654321" and one == "7654321 then 90000001"


def test_header_cells_are_units_first(spark):
    df = spark.createDataFrame([(1, "Ann Lee")], "row long, `John Smith` string")
    r = mask_table(df, "row", rules=[NAME])
    assert dict(r.header.collect()) == {"John Smith": "Person001"}  # the header row comes first
    assert r.masked.first()["John Smith"] == "Person002"


def test_template_specs_match_python_format(spark):
    from cloakline.functions.templates import render

    tpls = ["N{n:,}", "X{n:+05d}", "{orig:>8}|", "{orig:<8}|", "{n:x}{n:X}{n:o}", "{orig_len:03d}",
            "A{n:^7}B", "p{n: d}", "{orig:.2}", "100%{n}", "{{x}}{n}", "preserve_length"]
    df = spark.createDataFrame([(7, "ab c"), (1234567, "12345")], "n long, o string")
    rows = df.select("n", "o", *[render(t, F.col("n"), F.col("o")).alias(f"t{i}") for i, t in enumerate(tpls)]).collect()
    for row in rows:
        for i, t in enumerate(tpls):
            want = (str(row["n"]).rjust(len(row["o"]), "0") if t == "preserve_length"
                    else t.format(n=row["n"], orig=row["o"], orig_len=len(row["o"])))
            assert row[f"t{i}"] == want, t


def test_workbook_component_fallback_is_optional_and_skips_header_only_sheets(spark):
    from cloakline.plans.jobs import mask_workbook

    one = spark.createDataFrame([(1, "Ada Vogel")], "row long, Who string")
    two = spark.createDataFrame([(1, "Vogel"), (2, None), (3, " ")], "row long, Who string")
    off = mask_workbook([(one, "row"), (two, "row")], rules=[NAME])
    assert [r.Who for r in off[1].masked.orderBy("row").collect()] == ["Vogel", None, " "]
    on = mask_workbook([(one, "row"), (two, "row")], rules=[NAME], multi_col_names=True)
    assert [r.Who for r in on[1].masked.orderBy("row").collect()] == ["Person002", None, " "]
    bare = spark.createDataFrame([], "row long, Vogel string")
    head = mask_workbook([(one, "row"), (bare, "row")], rules=[NAME], multi_col_names=True)
    assert dict(head[1].header.collect()) == {"Vogel": "Vogel"}


def test_restore_every_shape(spark):
    from cloakline.plans.jobs import mask_nodes, mask_runs, restore_kind, restore_runs, restore_table

    sheet = spark.createDataFrame([(1, "kk@ll.mm", 2.5), (2, None, 1.0)], "row long, Mail string, X double")
    t = mask_table(sheet, "row", rules=ALL)
    assert sorted(map(str, restore_table(t.masked, "row", t.mapping).collect())) == sorted(map(str, sheet.collect()))
    runs = spark.createDataFrame([(1, 0, "Ada "), (1, 1, "Vogel left")], "p long, i int, text string")
    out, r = mask_runs(runs, ["p"], "i", "text", rules=ALL)
    assert [x.text for x in out.orderBy("i").collect()] == ["Person001 left", ""]
    assert [x.text for x in restore_runs(out, ["p"], "i", "text", r.mapping).orderBy("i").collect()] == ["Ada Vogel left", ""]
    html = spark.createDataFrame([(1, "<p class='Ada Vogel'>Ada Vogel</p> <b>kk@ll.mm</b>"), (2, "plain"), (3, None)], "id long, text string")
    masked, m = mask_nodes(html, ["id"], "text", ["id"], rules=ALL)
    got = dict(masked.collect())
    assert got == {1: "<p class='Ada Vogel'>Person001</p> <b>person001@anon.invalid</b>", 2: "plain", 3: None}
    back = restore_kind(masked, "text", text_col="text", key_cols=["id"], mapping=m.mapping, scope_cols=["id"])
    assert dict(back.collect()) == dict(html.collect())
    with pytest.raises(ValueError):
        restore_kind(html, "docx")


def test_container_order(spark):
    from cloakline.sources.units import container_order

    rows = [("t", 0, 1, "cell", 0, 0, 0), ("b", 0, 1, "paragraph", None, None, 5), ("u", 0, 1, "cell", 0, 1, 0),
            ("h", 1, 0, "paragraph", None, None, 0), ("a", 0, 0, "paragraph", None, None, 9)]
    df = spark.createDataFrame(rows, "x string, part int, box int, kind string, row int, cell int, para int")
    key = container_order(*[F.col(c) for c in ("part", "box", "kind", "row", "cell", "para")])
    assert [r.x for r in df.orderBy(key).collect()] == ["a", "b", "t", "u", "h"]


def test_container_paths(spark):
    """Nested tables at several depths against a plain recursive walk; missing parents, cycles, repeated ids, no rows."""
    import random

    from cloakline.sources.containers import container_paths

    rnd, rows = random.Random(4), []
    for f in range(3):
        for i in range(60):
            up = None if i < 2 else rnd.choice([None, 999, *range(max(0, i - 6), i)])
            rows.append((f, i, up, rnd.randrange(2), i if rnd.random() < 0.9 else None, "x"))
    df = spark.createDataFrame(rows, "file int, id int, up int, kind int, row int, path0 string").repartition(4)

    def walk(f, top):
        for r in sorted((r for r in rows if r[0] == f and (r[2] if r[2] != 999 else None) == top), key=lambda r: (r[3], -1 if r[4] is None else r[4])):
            yield r[1]
            yield from walk(f, r[1])

    got = container_paths(df, ["file"], "id", "up", ["kind", "row"])
    assert got.columns == [*df.columns, "path"] and got.count() == len(rows)
    for f in range(3):
        places = {r.id: r.path for r in got.where(F.col("file") == f).collect()}
        want = list(walk(f, None))
        assert len(want) == 60 and [places[i] for i in want] == sorted(places.values())
    chain = spark.range(300).selectExpr("id", "nullif(id, 0) - 1 AS up", "0 AS row")
    assert max(len(r.path) for r in container_paths(chain, [], "id", "up", ["row"]).collect()) == 300
    assert container_paths(df.where("id < 0"), ["file"], "id", "up", ["row"]).count() == 0
    for bad in (chain.withColumn("up", (F.col("id") + 1) % 300), chain.union(chain), chain.withColumn("path", F.lit(1))):
        with pytest.raises(ValueError):
            container_paths(bad, [], "id", "up", ["row"])


def test_markup_scan(spark):
    """Text nodes beside quoted attributes, comments, scripts and lone brackets; only these are masked and restored."""
    from cloakline.plans.jobs import mask_kind, restore_kind

    cases = ["<a title='1 > 0 kk@ll.mm'>Ada Vogel</a><!-- Ada > Vogel --> x", "<SCRIPT>Ada Vogel = '</p>'</Script >Ada Vogel", "2 < 3 and Ada Vogel <b",
             "<style a=1>kk@ll.mm", "<!-- open kk@ll.mm", "", None, "<p " + "a='>' " * 300 + ">kk@ll.mm", "<" * 50_000 + "Ada Vogel"]
    want = ["<a title='1 > 0 kk@ll.mm'>Person001</a><!-- Ada > Vogel --> x", "<SCRIPT>Ada Vogel = '</p>'</Script >Person001", "2 < 3 and Person001 <b",
            cases[3], cases[4], "", None, "<p " + "a='>' " * 300 + ">person001@anon.invalid", "<" * 50_000 + "Person001"]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    masked, m = mask_kind(df, "nodes", key_cols=["id"], text_col="text", scope_cols=["id"], rules=ALL)
    assert [r.text for r in masked.orderBy("id").collect()] == want
    back = restore_kind(masked, "nodes", key_cols=["id"], text_col="text", mapping=m.mapping, scope_cols=["id"])
    assert [r.text for r in back.orderBy("id").collect()] == cases


def test_tag_entities(spark):
    """A caller's tagger: bounded calls, keys kept as they are, offsets checked, entities usable by ``mask``."""
    from cloakline.operators.tagging import batches_of, tag_entities

    big = (1 << 62) + 1
    df = spark.createDataFrame([(big, "Ada Vogel met \U0001f600 Bo"), (None, "Bo"), (3, None), (4, ""), (5, "x" * 50)], "id long, text string").coalesce(1)

    def make():
        def tag(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 20
            return [[(t.index("Bo"), t.index("Bo") + 2, "PERSON")] if "Bo" in t else [] for t in texts]
        return tag

    found = tag_entities(df, make, ["id"], "text", batch_chars=20)
    assert sorted(map(tuple, found.collect()), key=str) == [(big, 16, 18, "PERSON"), (None, 0, 2, "PERSON")]
    assert found.schema.simpleString() == "struct<id:bigint,s:int,e:int,label:string>"
    assert [batches_of(t, 3).__class__ and list(batches_of(t, 3)) for t in (["ab", "c", "d"], ["abcd", ""], [""] * 2, [])] == [
        [(0, 2), (2, 3)], [(0, 1), (1, 2)], [(0, 2)], []]
    masked = mask(df.where("id IS NOT NULL"), "text", ["id"], ["id"], rules=[replace(NAME, entity=True)], entities=found.where("id IS NOT NULL")).masked
    assert {r.id: r.text for r in masked.collect()}[big].endswith(" Person001")
    for bad in ((-1, 2, "P"), (0, 99, "P"), (2, 2, "P"), (3, 1, "P"), (None, 2, "P"), (0.0, 2, "P"), (0, 2, None), (True, 2, "P")):
        wrong = lambda: lambda texts, x=bad: [[x, (0, 1, "OK")] if t else [] for t in texts]
        assert tag_entities(df.where("id = 5"), wrong, ["id"], "text", invalid="drop").collect() == [(5, 0, 1, "OK")]
        if bad[0] == -1:
            with pytest.raises(Exception, match="outside the text"):
                tag_entities(df.where("id = 5"), wrong, ["id"], "text").collect()
    assert tag_entities(df.where("id = 6"), make, ["id"], "text").count() == 0
    with pytest.raises(ValueError):
        tag_entities(df.withColumnRenamed("id", "s"), make, ["s"], "text")


def test_sheet_rows_are_dealt_before_they_become_units(spark, tmp_path):
    """One small file must not make the span stage of a sheet one task a branch."""
    rows = [(i, f"Ann{'abcdefghij'[i % 10]}", f"Ox{'abcdefghij'[i // 10 % 10]}") for i in range(100)]
    spark.createDataFrame(rows, "row long, `First Name` string, `Last Name` string").coalesce(1).write.parquet(str(tmp_path / "t"))
    units = sheet_units(spark.read.parquet(str(tmp_path / "t")), "row")
    cores = spark.sparkContext.defaultParallelism
    placed = units.where("_unit.hdr = 1").groupBy(F.spark_partition_id().alias("p"), "_cell").agg(F.count("*").alias("n")).collect()
    for cell, n in ((True, 200), (False, 200)):
        mine = [r["n"] for r in placed if r["_cell"] == cell]
        assert sum(mine) == n and len(mine) > cores // 2 and max(mine) <= n // 2
