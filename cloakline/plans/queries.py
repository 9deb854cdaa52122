"""Registered queries: each reads the given tables (or data Spark derives from
them) and runs over whole tables.  ``QUERIES[name](spark, sf_dir)`` returns a
DataFrame; ``ORACLES[name]`` is the independent DuckDB SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import registry as reg
from ..operators.restore import roundtrip_audit
from ..operators.spans import candidates_table, detect
from ..rules import load_rules, rule
from ..session import checkpointed, stored
from ..sources.fixtures import ORDER_UNITS_SQL, order_units, table
from . import oracle as O
from .jobs import mask, restore

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _rules(*names, proper_nouns=False):
    rs = load_rules(proper_nouns=proper_nouns)
    return [r for r in rs if r.name in names] if names else rs


DOCS = "(SELECT doc_id, text FROM documents)"
ORD = ORDER_UNITS_SQL


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _spread(df: DataFrame, ids) -> DataFrame:
    """Hash-spread units over the shuffle partitions before per-row regex work
    (small test tables are single parquet files = one scan task)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *ids)


def _cands(df: DataFrame, rules, ids, cols=("s", "e", "v")) -> DataFrame:
    units = _spread(df, ids).select(*ids, F.col("text").alias("_text")).persist()
    return candidates_table(units, rules, list(ids)).select(*ids, *cols)


# ── D1, D8-D12: candidate spans ──────────────────────────────────────────────

@register("spans_email", f"SELECT doc_id, s, e, v FROM {O.email_spans(DOCS, ['doc_id'])}")
def spans_email(spark, d):
    return _cands(_docs(spark, d), _rules("email"), ["doc_id"])


@register("spans_name", f"SELECT doc_id, s, e, v FROM {O.rule_spans(_rules('name')[0], DOCS, ['doc_id'])}")
def spans_name(spark, d):
    return _cands(_docs(spark, d), _rules("name"), ["doc_id"])


@register("spans_proper_noun",
          f"SELECT doc_id, s, e, v FROM {O.rule_spans(_rules('proper_noun', proper_nouns=True)[0], DOCS, ['doc_id'])}")
def spans_proper_noun(spark, d):
    return _cands(_docs(spark, d), _rules("proper_noun", proper_nouns=True), ["doc_id"])


@register("spans_id_username", f"""SELECT unit_seq, rule, s, e, v FROM
  {O.candidates(_rules('id', 'username'), ORD, ['unit_seq'])}""")
def spans_id_username(spark, d):
    return _cands(order_units(spark, d), _rules("id", "username"), ["unit_seq"], ("rule", "s", "e", "v"))


# ── O1/O2: overlap resolution ────────────────────────────────────────────────

def _kept_sql(rules, src, ids, select):
    ctes, last = O.kept(rules, src, ids)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {select} FROM {last}"


@register("resolve_overlaps", _kept_sql(_rules(), ORD, ["unit_seq"], "unit_seq, rule, s, e, v"))
def resolve_overlaps(spark, d):
    rules = _rules()
    units = _spread(order_units(spark, d), ["unit_seq"]).select("unit_seq", F.col("text").alias("_text"))
    names = reg.rule_names(rules)
    return (detect(units, rules).select("unit_seq", F.explode_outer("_spans").alias("h"))
            .where(F.col("h").isNotNull())
            .select("unit_seq", F.element_at(names, F.col("h.k") + 1).alias("rule"),
                    F.col("h.s").alias("s"), F.col("h.e").alias("e"), F.col("h.v").alias("v")))


# ── R1-R8: registry, splice, mapping, stats ─────────────────────────────────

def _registry_ctes(rules, src, ids, scope, pos):
    ctes, last = O.kept(rules, src, ids)
    ctes.append(f"registry AS {O.registry_sql(rules, last, scope, pos)}")
    return ctes, last


def _docs_registry_ctes(rules):
    return _registry_ctes(rules, DOCS, ["doc_id"], ["doc_id"], "CAST(k AS BIGINT) * 1000000000 + s")


def _orders_registry_ctes(rules):
    return _registry_ctes(rules, ORD, ["unit_seq"], [], "CAST(unit_seq AS BIGINT) * 10000000000 + CAST(k AS BIGINT) * 1000000000 + s")


def _with(ctes, body):
    return "WITH " + ",\n".join(ctes) + "\n" + body


_C, _L = _docs_registry_ctes(_rules())


@register("registry_docs", _with(_C, "SELECT doc_id, rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry"))
def registry_docs(spark, d):
    r = mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules())
    return r.registry.select("doc_id", "rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym")


def _splice_docs_sql(ctes, last, src=DOCS, ids=("doc_id",), scope=("doc_id",)):
    ids = list(ids)
    on_scope = " AND ".join(f"x.{c} = r.{c}" for c in scope)
    join = f"JOIN registry r ON {on_scope + ' AND ' if scope else ''}x.rule = r.rule AND {O.strip_sql('x.v')} = r.key"
    spans = f"(SELECT {', '.join('x.' + c for c in ids)}, x.s, x.e, r.pseudonym FROM {last} x {join})"
    return _with(ctes, f"SELECT {', '.join(ids)}, text FROM {O.splice_sql(src, ids, spans)}")


@register("masked_docs", _splice_docs_sql(_C, _L))
def masked_docs(spark, d):
    return mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules()).masked


@register("mapping_docs", _with(_C, """SELECT doc_id, pseudonym, arg_max(key, fpos) AS original
  FROM registry GROUP BY doc_id, pseudonym"""))
def mapping_docs(spark, d):
    r = mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules())
    return r.mapping.select("doc_id", "pseudonym", "original")


@register("stats_docs", _with(_C, "SELECT doc_id, rule, count(*) AS count FROM registry GROUP BY doc_id, rule"))
def stats_docs(spark, d):
    r = mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules())
    return r.stats.select("doc_id", "rule", F.col("count").cast("bigint").alias("count"))


_OC, _OL = _orders_registry_ctes(_rules())


def _orders_masking(spark, d, rules=None):
    return mask(order_units(spark, d), "text", ["unit_seq"], None, rules=rules or _rules())


def _masked_and_mapping(r):
    """What a restore starts from, written as Parquet; the hits and the registry that
    the masking keeps are given back before it."""
    out = stored(r.masked)[0], stored(r.mapping)[0]
    r.unpersist()
    return out


@register("registry_orders", _with(_OC, "SELECT rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry"))
def registry_orders(spark, d):
    r = _orders_masking(spark, d)
    return r.registry.select("rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym")


@register("masked_orders", _splice_docs_sql(_OC, _OL, ORD, ["unit_seq"], []))
def masked_orders(spark, d):
    return _orders_masking(spark, d).masked.select("unit_seq", "text")


@register("mapping_orders", _with(_OC, "SELECT pseudonym, arg_max(key, fpos) AS original FROM registry GROUP BY pseudonym"))
def mapping_orders(spark, d):
    return _orders_masking(spark, d).mapping.select("pseudonym", "original")


@register("stats_total_orders", _with(_OC, "SELECT rule, count(*) AS count FROM registry GROUP BY ROLLUP (rule)"))
def stats_total_orders(spark, d):
    r = _orders_masking(spark, d)
    # rollup over the corpus registry: per-rule counts plus the total row
    regs = r.registry.withColumn("_scope", F.lit(0))
    return reg.stats_with_total(regs).select("rule", F.col("count").cast("bigint").alias("count"))


_COLL_RULES = [rule("id", "ref{n}", r"\b\d{7,8}\b"),
               rule("username", "ref{n}", r"\b(?=[a-zA-Z0-9]*[a-zA-Z])(?=[a-zA-Z0-9]*\d)[a-zA-Z0-9]{8}\b")]
_CC, _CL = _orders_registry_ctes(_COLL_RULES)


@register("collisions_orders", _with(_CC, """SELECT pseudonym, count(*) AS n_values FROM registry
  GROUP BY pseudonym HAVING count(*) > 1"""))
def collisions_orders(spark, d):
    r = _orders_masking(spark, d, rules=_COLL_RULES)
    regs = r.registry.withColumnRenamed("original", "key").withColumn("_scope", F.lit(0))
    return reg.collisions(regs).select("pseudonym", F.col("n_values").cast("bigint").alias("n_values"))


# ── T1-T5: restore and audit ────────────────────────────────────────────────

@register("restore_docs", "SELECT doc_id, text FROM documents")
def restore_docs(spark, d):
    r = mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules())
    m = r.mapping
    return restore(r.masked, "text", ["doc_id"], m, ["doc_id"], mode="sequential")


@register("roundtrip_orders", "SELECT true AS ok, count(*) AS n FROM orders")
def roundtrip_orders(spark, d):
    units = order_units(spark, d)
    masked, mapping = _masked_and_mapping(_orders_masking(spark, d))
    back = restore(masked, "text", ["unit_seq"], mapping, None, mode="single_pass")
    audit = roundtrip_audit(units, back, ["unit_seq"], "text")
    return audit.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


@register("restore_orders", f"SELECT unit_seq, text FROM {ORD}")
def restore_orders(spark, d):
    """T1 with one mapping for the whole corpus."""
    masked, mapping = _masked_and_mapping(_orders_masking(spark, d))
    return restore(masked, "text", ["unit_seq"], mapping, None).select("unit_seq", "text")


_COPY_RULES = [replace(r, template=t) for r, t in zip(_rules("email", "id", "username"), ("<{orig}|{n}>", "#{orig}", "({orig})"))]


@register("restore_copies", f"SELECT unit_seq, text FROM {ORD}")
def restore_copies(spark, d):
    """T5 with pseudonyms that hold the original, so without a common shape."""
    r = _orders_masking(spark, d, rules=_COPY_RULES)
    return restore(checkpointed(r.masked), "text", ["unit_seq"], r.mapping, None, mode="single_pass").select("unit_seq", "text")


# ── S8 / M1-M6: cells and split names ───────────────────────────────────────

from ..sources.fixtures import staff, staff_sql  # noqa: E402
from ..sources.units import cell_units  # noqa: E402
from .jobs import mask_table, restore_table  # noqa: E402

STAFF_COLS = ["First Name", "Last Name", "Email", "Balance"]
STAFF_STR = ["First Name", "Last Name", "Email"]


@register("cell_units", "WITH staff AS " + staff_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT row, {i} AS col_idx, '{c}' AS col, \"{c}\" AS text FROM staff" for i, c in enumerate(STAFF_STR)))
def q_cell_units(spark, d):
    return cell_units(staff(spark, d), "row").select("row", F.col("col_idx"), "col", "text")


def _staff_units_sql(prescan: bool) -> str:
    hdr = " UNION ALL ".join(f"SELECT CAST(1000000000000 + {i} AS BIGINT) AS uid, CAST(NULL AS BIGINT) AS row, "
                             f"'{c}' AS col, '{c}' AS text, true AS cell" for i, c in enumerate(STAFF_COLS))
    cells = " UNION ALL ".join(f"SELECT 1100000000000 + row * 100 + {i}, row, '{c}', \"{c}\", true FROM staff"
                               for i, c in enumerate(STAFF_STR))
    parts = [hdr, cells]
    if prescan:
        parts.append("SELECT 100000000000 + row * 100, row, NULL, concat_ws(' ', \"First Name\", \"Last Name\", "
                     "\"Email\"), false FROM staff")
        parts.append("SELECT 100000000000 + row * 100 + 1, row, NULL, \"First Name\" || ' ' || \"Last Name\", "
                     "false FROM staff")
    return "(" + "\nUNION ALL\n".join(parts) + ")"


def _staff_sql(prescan: bool) -> str:
    rules = _rules()
    src = "(SELECT uid, text FROM U)"
    ctes = ["staff AS " + staff_sql(), "U AS " + _staff_units_sql(prescan)]
    kc, last = O.kept(rules, src, ["uid"])
    ctes += kc
    ctes.append(f"K AS (SELECT uid, k, rule, s, e, v FROM {last})")
    if prescan:
        name_k = [r.name for r in rules].index("name")
        ctes.append(f"""src AS (SELECT DISTINCT rule, {O.strip_sql('v')} AS key FROM K WHERE uid < 1000000000000
          AND rule IN ('name', 'proper_noun') AND contains({O.strip_sql('v')}, ' '))""")
        ctes.append(f"""wd AS (SELECT DISTINCT rule, key, unnest(string_split_regex(key, '[{O.WS}]+')) AS word FROM src)""")
        ctes.append("comp AS (SELECT word FROM wd WHERE length(word) >= 2 GROUP BY word HAVING count(*) = 1)")
        ctes.append(f"""fb AS (SELECT u.uid, {name_k} AS k, 'name' AS rule, 0 AS s, CAST(length(u.text) AS INTEGER) AS e,
          {O.strip_sql('u.text')} AS v FROM U u WHERE u.cell AND u.text IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM K WHERE K.uid = u.uid)
          AND {O.strip_sql('u.text')} IN (SELECT word FROM comp))""")
        ctes.append("events AS (SELECT * FROM K UNION ALL SELECT * FROM fb)")
    else:
        ctes.append("events AS (SELECT * FROM K)")
    ctes.append("registry AS " + O.registry_sql(
        rules, "events", [], "CAST(uid AS HUGEINT) * 10000000000 + CAST(k AS HUGEINT) * 1000000000 + s"))
    spans = (f"(SELECT x.uid, x.s, x.e, r.pseudonym FROM events x JOIN registry r ON x.rule = r.rule "
             f"AND {O.strip_sql('x.v')} = r.key WHERE x.uid >= 1000000000000)")
    ctes.append(f"C AS (SELECT u.row, u.col, o.text FROM {O.splice_sql('(SELECT uid, text FROM U WHERE cell)', ['uid'], spans)} o "
                f"JOIN U u ON u.uid = o.uid WHERE u.row IS NOT NULL)")
    pivot = ", ".join(f"max(CASE WHEN col = '{c}' THEN text END) AS \"{c}\"" for c in STAFF_STR)
    return _with(ctes, f"""SELECT s.row, p."First Name", p."Last Name", p."Email", s."Balance" FROM staff s
      LEFT JOIN (SELECT row, {pivot} FROM C GROUP BY row) p ON p.row = s.row""")


@register("staff_cells", _staff_sql(False))
def staff_cells(spark, d):
    return mask_table(staff(spark, d), "row", rules=_rules(), multi_col_names=False).masked


@register("split_name_table", _staff_sql(True))
def split_name_table(spark, d):
    return mask_table(staff(spark, d), "row", rules=_rules(), multi_col_names=True).masked


@register("restore_staff", "WITH staff AS " + staff_sql() + """
SELECT row, "First Name", "Last Name", "Email", "Balance" FROM staff""")
def restore_staff(spark, d):
    """T2 of a wide table with split names: masked, then restored in place."""
    df = staff(spark, d)
    t = mask_table(df, "row", multi_col_names=True)
    return restore_table(checkpointed(t.masked), "row", t.mapping).select("row", *STAFF_COLS)


# ── S9: page lines and page text ─────────────────────────────────────────────

from ..sources.units import line_units, page_text, paragraph_units, paragraph_write_back  # noqa: E402

LINE_RE2 = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
LINES_SQL = f"""(SELECT page_id, CAST(i - 1 AS INTEGER) AS line_no, parts[i] AS text FROM (
  SELECT page_id, parts, unnest(generate_series(1, len(parts))) AS i FROM (
    SELECT page_id, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS parts
    FROM (SELECT page_id, string_split_regex(coalesce(html, ''), {O.q(LINE_RE2)}) AS p FROM pages))))"""


@register("line_units", f"SELECT page_id, line_no, text FROM {LINES_SQL}")
def q_line_units(spark, d):
    return line_units(table(spark, d, "pages"), ["page_id"], None, "html").select("page_id", "line_no", "text")


def _page_text_sql():
    rules = _rules()
    ctes, last = _registry_ctes(rules, "L", ["page_id", "line_no"], ["page_id"],
                                "CAST(line_no AS BIGINT) * 10000000000 + CAST(k AS BIGINT) * 1000000000 + s")
    ctes.insert(0, f"L AS {LINES_SQL}")
    spans = (f"(SELECT x.page_id, x.line_no, x.s, x.e, r.pseudonym FROM {last} x JOIN registry r "
             f"ON x.page_id = r.page_id AND x.rule = r.rule AND {O.strip_sql('x.v')} = r.key)")
    ctes.append(f"R AS {O.splice_sql('L', ['page_id', 'line_no'], spans)}")
    return _with(ctes, """SELECT p.page_id, '--- Page 1 ---' || chr(10) ||
        coalesce((SELECT string_agg(text, chr(10) ORDER BY line_no) FROM R WHERE R.page_id = p.page_id), '') AS text
      FROM pages p""")


@register("page_text", _page_text_sql())
def q_page_text(spark, d):
    pages = table(spark, d, "pages")
    lines = line_units(pages, ["page_id"], None, "html")
    red = mask(lines, "text", ["page_no", "line_no"], ["page_id"], rules=_rules()).masked
    return page_text(red, pages.select("page_id", F.lit(1).alias("page_no")), ["page_id"])


# ── S5: fragmented paragraphs (conversation turns as runs) ───────────────────

def _fragment_sql():
    rules = _rules()
    merged = """(SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS text, min(turn) AS first_turn
      FROM conversations GROUP BY conv_id)"""
    ctes, last = _registry_ctes(rules, "P", ["conv_id"], ["conv_id"], "CAST(k AS BIGINT) * 1000000000 + s")
    ctes.insert(0, f"P AS {merged}")
    spans = (f"(SELECT x.conv_id, x.s, x.e, r.pseudonym FROM {last} x JOIN registry r "
             f"ON x.conv_id = r.conv_id AND x.rule = r.rule AND {O.strip_sql('x.v')} = r.key)")
    ctes.append(f"N AS {O.splice_sql('P', ['conv_id'], spans)}")
    return _with(ctes, """SELECT c.conv_id, c.turn, CASE WHEN n.text = p.text THEN c.text
        WHEN c.turn = p.first_turn THEN n.text ELSE '' END AS text
      FROM conversations c JOIN P p ON p.conv_id = c.conv_id JOIN N n ON n.conv_id = c.conv_id""")


@register("fragment_merge", _fragment_sql())
def fragment_merge(spark, d):
    conv = table(spark, d, "conversations")
    paras = paragraph_units(conv, ["conv_id"], "turn", "text")
    red = mask(paras, "text", ["conv_id"], ["conv_id"], rules=_rules()).masked
    return paragraph_write_back(conv, paras, red, ["conv_id"], "turn", "text").select("conv_id", "turn", "text")


# ── D2/D3, D12, J2: entities and proper nouns ───────────────────────────────

from ..sources.fixtures import entities as entity_table  # noqa: E402


def _entity_sql():
    rules = _rules()
    name_rule = next(r for r in rules if r.name == "name")
    ents = O.title_spans("(SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0)", ["doc_id"], "[A-Z][a-z]+",
                         1 << 30, 2, name_rule.exclusions, sep="[ ]+")
    parts = []
    for k, r in enumerate(rules):
        body = ents if r.name == "name" else O.rule_spans(r, DOCS, ["doc_id"])
        parts.append(f"SELECT doc_id, {k} AS k, {O.q(r.name)} AS rule, s, e, v FROM {body}")
    ctes = ["cand AS (" + "\nUNION ALL\n".join(parts) + ")", "lvl0 AS (SELECT * FROM cand WHERE k = 0)"]
    for k in range(1, len(rules)):
        ctes.append(f"""lvl{k} AS (SELECT * FROM lvl{k - 1} UNION ALL SELECT c.* FROM cand c WHERE c.k = {k}
          AND NOT EXISTS (SELECT 1 FROM lvl{k - 1} x WHERE x.doc_id = c.doc_id AND x.s < c.e AND x.e > c.s))""")
    last = f"lvl{len(rules) - 1}"
    ctes.append(f"registry AS {O.registry_sql(rules, last, ['doc_id'], 'CAST(k AS BIGINT) * 1000000000 + s')}")
    return _splice_docs_sql(ctes, last)


@register("entity_docs", _entity_sql())
def entity_docs(spark, d):
    ents = entity_table(spark, d)
    return mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], rules=_rules(), entities=ents).masked


@register("entity_spans", """SELECT doc_id, s, e, label FROM (SELECT g.doc_id, g.s, g.e,
  CASE WHEN g.doc_id % 2 = 0 THEN 'PERSON' ELSE 'GPE' END AS label FROM """ + O.title_spans(
    DOCS, ["doc_id"], "[A-Z][a-z]+", 1 << 30, 2, sep="[ ]+") + " g)")
def entity_spans(spark, d):
    return entity_table(spark, d).select("doc_id", "s", "e", "label")


_PC, _PL = _docs_registry_ctes(_rules(proper_nouns=True))


@register("proper_noun_docs", _splice_docs_sql(_PC, _PL))
def proper_noun_docs(spark, d):
    return mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], proper_nouns=True).masked


@register("proper_noun_registry", _with(_PC, """SELECT doc_id, rule, key AS original, CAST(n AS BIGINT) AS n,
  pseudonym FROM registry WHERE rule = 'proper_noun'"""))
def proper_noun_registry(spark, d):
    r = mask(_docs(spark, d), "text", ["doc_id"], ["doc_id"], proper_nouns=True)
    return (r.registry.where(F.col("rule") == "proper_noun")
            .select("doc_id", "rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym"))


# ── R9: incremental registry (two batches of order units) ───────────────────

CUTOFF = "1995-01-01"


def _incremental_sql():
    rules = _rules()
    src = f"""(SELECT unit_seq, text, CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 0 ELSE 1 END AS batch
               FROM {ORD})"""
    ctes, last = O.kept(rules, "B", ["unit_seq"])
    ctes.insert(0, f"B AS {src}")
    ctes.append(f"KB AS (SELECT x.*, b.batch FROM {last} x JOIN B b ON b.unit_seq = x.unit_seq)")
    ctes.append("registry AS " + O.registry_sql(
        rules, "KB", [], "CAST(batch AS HUGEINT) * 100000000000000000 + CAST(unit_seq AS HUGEINT) * 10000000000 "
                         "+ CAST(k AS HUGEINT) * 1000000000 + s"))
    return _with(ctes, "SELECT rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry")


@register("registry_incremental", _incremental_sql())
def registry_incremental(spark, d):
    units = order_units(spark, d).withColumn(
        "_ord", F.struct(F.when(F.col("o_orderdate") < F.lit(CUTOFF).cast("timestamp_ntz"), 0).otherwise(1)
                         .alias("batch"), F.col("unit_seq")))
    first = mask(units.where(F.col("_ord.batch") == 0), "text", ["unit_seq"], None, rules=_rules(),
                   order_col="_ord")
    second = mask(units.where(F.col("_ord.batch") == 1), "text", ["unit_seq"], None, rules=_rules(),
                    order_col="_ord", prior=first)
    return second.registry.select("rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym")


# ── R4/R5: templates ─────────────────────────────────────────────────────────

_TPL_RULES = [
    rule("email", "mail{n:x}-{orig_len:03d}", r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    rule("name", "{orig:.4}{n:>5}", r"\b[A-Z][a-z]{1,25}(?:\s+[A-Z][a-z]{1,25}){1,3}\b", min_word_length=2),
    rule("id", "preserve_length", r"\b\d{7,8}\b"),
    rule("username", "U{n:^7}|{orig}", r"\b(?=[a-zA-Z0-9]*[a-zA-Z])(?=[a-zA-Z0-9]*\d)[a-zA-Z0-9]{8}\b"),
]
_TC, _TL = _orders_registry_ctes(_TPL_RULES)


@register("template_render", _with(_TC, "SELECT rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry"))
def template_render(spark, d):
    r = _orders_masking(spark, d, rules=_TPL_RULES)
    return r.registry.select("rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym")


# ── S10-S12: mapping documents and paths ────────────────────────────────────

from ..sources.mapping_io import MASKED_STEM, mapping_documents, mask_paths, read_mapping, restore_paths  # noqa: E402

_DOC_PATH = "'/data/' || source || '/doc' || CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.docx' " \
            "WHEN 1 THEN '.PDF' WHEN 2 THEN '.xlsx' ELSE '.odt' END"


def _doc_path():
    ext = (F.when(F.pmod("doc_id", F.lit(4)) == 0, ".docx").when(F.pmod("doc_id", F.lit(4)) == 1, ".PDF")
           .when(F.pmod("doc_id", F.lit(4)) == 2, ".xlsx").otherwise(".odt"))
    return F.concat(F.lit("/data/"), F.col("source"), F.lit("/doc"), F.col("doc_id").cast("string"), ext)


@register("mapping_json", _with(_C, """SELECT doc_id, 'mapping' AS kind, pseudonym AS name, arg_max(key, fpos) AS value
  FROM registry GROUP BY doc_id, pseudonym
  UNION ALL SELECT doc_id, 'stats', rule, CAST(count(*) AS VARCHAR) FROM registry GROUP BY doc_id, rule"""))
def mapping_json(spark, d):
    docs = table(spark, d, "documents")
    r = mask(docs.select("doc_id", "text"), "text", ["doc_id"], ["doc_id"], rules=_rules())
    files = docs.select("doc_id", _doc_path().alias("source_file")).select(
        "doc_id", "source_file", mask_paths(F.col("source_file"))["masked"].alias("masked_file"))
    js = mapping_documents(r.registry, ["doc_id"], files)
    back = read_mapping(js, ["doc_id"])
    parsed = js.select("doc_id", F.from_json("json", "stats map<string,bigint>").alias("d"))
    stats = parsed.select("doc_id", F.explode("d.stats").alias("name", "c")).select(
        "doc_id", F.lit("stats").alias("kind"), "name", F.col("c").cast("string").alias("value"))
    return back.select("doc_id", F.lit("mapping").alias("kind"), F.col("pseudonym").alias("name"),
                       F.col("original").alias("value")).unionByName(stats)


_SFX = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1)"
_STEM = f"left(regexp_extract(path, '([^/]*)$', 1), length(regexp_extract(path, '([^/]*)$', 1)) - length({_SFX}))"
_DIRP = "regexp_extract(path, '^(.*/)?[^/]*$', 1)"
_RSFX = f"CASE lower({_SFX}) WHEN '.pdf' THEN '.txt' WHEN '.docx' THEN '.docx' WHEN '.xlsx' THEN '.xlsx' " \
        f"WHEN '.odt' THEN '.odt' END"


@register("paths", f"""WITH a AS (SELECT doc_id, {_DOC_PATH} AS path FROM documents),
  b AS (SELECT doc_id, path, {_RSFX} IS NOT NULL AS supported,
               {_DIRP} || {_STEM} || '{MASKED_STEM}' || {_RSFX} AS masked,
               {_DIRP} || {_STEM} || '_mapping.json' AS mapping FROM a),
  c AS (SELECT *, masked AS path2 FROM b)
  SELECT doc_id, supported, masked, mapping,
    regexp_extract(path2, '^(.*/)?[^/]*$', 1) || left(regexp_extract(path2, '([^/]*)$', 1),
      length(regexp_extract(path2, '([^/]*)$', 1)) - length(regexp_extract(regexp_extract(path2, '([^/]*)$', 1),
      '^.+(\\.[^.]+)$', 1))) || '_restored' || lower(regexp_extract(regexp_extract(path2, '([^/]*)$', 1),
      '^.+(\\.[^.]+)$', 1)) AS restored,
    regexp_extract(path2, '^(.*/)?[^/]*$', 1) || regexp_replace(left(regexp_extract(path2, '([^/]*)$', 1),
      length(regexp_extract(path2, '([^/]*)$', 1)) - length(regexp_extract(regexp_extract(path2, '([^/]*)$', 1),
      '^.+(\\.[^.]+)$', 1))), '{MASKED_STEM}$', '') || '_mapping.json' AS restore_mapping
  FROM c""")
def paths(spark, d):
    docs = table(spark, d, "documents").select("doc_id", _doc_path().alias("path"))
    red = docs.select("doc_id", mask_paths(F.col("path")).alias("r"))
    back = red.select("doc_id", "r", restore_paths(F.col("r.masked")).alias("b"))
    return back.select("doc_id", F.col("r.supported").alias("supported"), F.col("r.masked").alias("masked"),
                       F.col("r.mapping").alias("mapping"), F.col("b.restored").alias("restored"),
                       F.col("b.mapping").alias("restore_mapping"))


# ── R9 as a stream: foreachBatch over monthly event files ───────────────────

import uuid  # noqa: E402

from ..session import ensure_checkpoint_dir  # noqa: E402
from ..sources.fixtures import event_units  # noqa: E402
from ..streaming import incremental  # noqa: E402


def _stream_sql():
    rules = _rules()
    src = """(SELECT event_id AS unit_seq, year(ts) * 100 + month(ts) AS m,
               'account ' || CAST(user_id + 1000000 AS VARCHAR) || ' ' || event_type AS text FROM events)"""
    ctes, last = O.kept(rules, "E", ["unit_seq"])
    ctes.insert(0, f"E AS {src}")
    ctes.append(f"KB AS (SELECT x.*, b.m FROM {last} x JOIN E b ON b.unit_seq = x.unit_seq)")
    ctes.append("registry AS " + O.registry_sql(
        rules, "KB", [], "CAST(m AS HUGEINT) * 100000000000000000 + CAST(unit_seq AS HUGEINT) * 10000000000 "
                         "+ CAST(k AS HUGEINT) * 1000000000 + s"))
    return _with(ctes, "SELECT rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry")


@register("stream_registry", _stream_sql())
def stream_registry(spark, d):
    """Events staged as one file per month (written in month order into the
    shared checkpoint folder), read as a file stream one file per trigger."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events").withColumn("m", F.year("ts") * 100 + F.month("ts"))
    months = [r[0] for r in events.select("m").distinct().orderBy("m").collect()]
    for m in months:  # a handful of months; each write is a distributed job
        events.where(F.col("m") == m).drop("m").coalesce(1).write.parquet(f"{base}/src/m={m}")
    stream = (spark.readStream.schema(table(spark, d, "events").schema.add("m", "integer"))
              .option("maxFilesPerTrigger", 1).parquet(f"{base}/src"))
    q = incremental.start(event_units(stream), "text", ["unit_seq"], _rules(), state_dir=f"{base}/state")
    q.awaitTermination()
    reg_df = incremental.latest_registry(spark, f"{base}/state", event_units(events), ["unit_seq"])
    return reg_df.select("rule", F.col("key").alias("original"), F.col("n").cast("bigint").alias("n"), "pseudonym")


# ── D13: the example detector set ───────────────────────────────────────────

from ..rules import EXAMPLE_CONFIG, build_rules, load_config  # noqa: E402
from ..sources.fixtures import contact_units, contact_units_sql  # noqa: E402

_EX_RULES = build_rules(load_config(EXAMPLE_CONFIG))
_EC, _EL = _registry_ctes(_EX_RULES, "CU", ["unit_seq"], [], "CAST(unit_seq AS BIGINT) * 10000000000 "
                                                               "+ CAST(k AS BIGINT) * 1000000000 + s")
_EC.insert(0, f"CU AS {contact_units_sql()}")


@register("example_rules", _splice_docs_sql(_EC, _EL, "CU", ["unit_seq"], []))
def example_rules(spark, d):
    return mask(contact_units(spark, d), "text", ["unit_seq"], None, rules=_EX_RULES).masked


@register("example_registry", _with(_EC, "SELECT rule, key AS original, CAST(n AS BIGINT) AS n, pseudonym FROM registry"))
def example_registry(spark, d):
    r = mask(contact_units(spark, d), "text", ["unit_seq"], None, rules=_EX_RULES)
    return r.registry.select("rule", "original", F.col("n").cast("bigint").alias("n"), "pseudonym")


# ── T1 vs T5: sequential restore rewrites a restored value, single pass not ──

HAZARD_SQL = """(SELECT o_orderkey AS unit_seq, 'id ' || CAST(o_orderkey + 1000000 AS VARCHAR) || ' code '
  || CAST(o_orderkey + 90000000 AS VARCHAR) AS text FROM orders)"""


def hazard_units(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("unit_seq"), F.concat(
        F.lit("id "), (F.col("o_orderkey") + 1000000).cast("string"), F.lit(" code "),
        (F.col("o_orderkey") + 90000000).cast("string")).alias("text"))


@register("restore_modes", f"""SELECT unit_seq,
  replace(replace('id 0000001 code 00000002', '00000002', CAST(unit_seq + 90000000 AS VARCHAR)),
          '0000001', CAST(unit_seq + 1000000 AS VARCHAR)) AS sequential,
  text AS single_pass FROM {HAZARD_SQL}""")
def restore_modes(spark, d):
    units = hazard_units(spark, d)
    rules = _rules("id")
    r = mask(units, "text", ["unit_seq"], ["unit_seq"], rules=rules)
    masked, mapping = stored(r.masked)[0], stored(r.mapping)[0]  # read by both restores
    seq = restore(masked, "text", ["unit_seq"], mapping, ["unit_seq"], mode="sequential")
    one = restore(masked, "text", ["unit_seq"], mapping, ["unit_seq"], mode="single_pass")
    return (seq.withColumnRenamed("text", "sequential")
            .join(one.withColumnRenamed("text", "single_pass"), "unit_seq"))


# ── S8 + M6: a workbook of several sheets sharing one registry ──────────────

from ..sources.fixtures import staff_sheets  # noqa: E402
from .jobs import mask_workbook  # noqa: E402


def _workbook_sql() -> str:
    rules = _rules()
    name_k = [r.name for r in rules].index("name")
    S = "CAST(sheet AS BIGINT) * 10000000000000"
    hdr = " UNION ALL ".join(f"SELECT {S} + 1000000000000 + {i} AS uid, sheet, CAST(NULL AS BIGINT) AS row, "
                             f"'{c}' AS col, '{c}' AS text, true AS cell FROM sheets" for i, c in enumerate(STAFF_COLS))
    cells = " UNION ALL ".join(f"SELECT {S} + 1100000000000 + row * 100 + {i}, sheet, row, '{c}', \"{c}\", true "
                               f"FROM staffs" for i, c in enumerate(STAFF_STR))
    pre = (f"SELECT {S} + 100000000000 + row * 100, sheet, row, NULL, concat_ws(' ', \"First Name\", "
           f"\"Last Name\", \"Email\"), false FROM staffs UNION ALL "
           f"SELECT {S} + 100000000000 + row * 100 + 1, sheet, row, NULL, \"First Name\" || ' ' || \"Last Name\", "
           f"false FROM staffs")
    ctes = ["staff0 AS " + staff_sql(),
            "staffs AS (SELECT s.*, CAST(dense_rank() OVER (ORDER BY c.c_mktsegment) - 1 AS BIGINT) AS sheet "
            "FROM staff0 s JOIN customer c ON c.c_custkey = s.row)",
            "sheets AS (SELECT DISTINCT sheet FROM staffs)",
            f"U AS ({hdr} UNION ALL {cells} UNION ALL {pre})"]
    kc, last = O.kept(rules, "(SELECT uid, text FROM U)", ["uid"])
    ctes += kc
    ctes.append(f"K AS (SELECT uid, k, rule, s, e, v FROM {last})")
    # sources for sheet j: multi-word name values of the pre-scans of sheets <= j
    ctes.append(f"""src AS (SELECT rule, {O.strip_sql('v')} AS key, min(u.sheet) AS sheet FROM K JOIN U u USING (uid)
      WHERE NOT u.cell AND rule IN ('name', 'proper_noun') AND contains({O.strip_sql('v')}, ' ')
      GROUP BY rule, {O.strip_sql('v')})""")
    ctes.append(f"wd AS (SELECT DISTINCT rule, key, sheet, unnest(string_split_regex(key, '[{O.WS}]+')) AS word FROM src)")
    # first and second source (in sheet order) holding each word
    ctes.append("""wr AS (SELECT word, sheet, row_number() OVER (PARTITION BY word ORDER BY sheet, rule, key) AS rn
      FROM wd WHERE length(word) >= 2)""")
    ctes.append("""comp AS (SELECT word, max(CASE WHEN rn = 1 THEN sheet END) AS lo,
      max(CASE WHEN rn = 2 THEN sheet END) AS hi FROM wr GROUP BY word)""")
    ctes.append(f"""fb AS (SELECT u.uid, {name_k} AS k, 'name' AS rule, 0 AS s, CAST(length(u.text) AS INTEGER) AS e,
      {O.strip_sql('u.text')} AS v FROM U u WHERE u.cell AND u.text IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM K WHERE K.uid = u.uid)
      AND EXISTS (SELECT 1 FROM comp c WHERE c.word = {O.strip_sql('u.text')} AND c.lo <= u.sheet
                  AND (c.hi IS NULL OR c.hi > u.sheet)))""")
    ctes.append("events AS (SELECT * FROM K UNION ALL SELECT * FROM fb)")
    ctes.append("registry AS " + O.registry_sql(
        rules, "events", [], "CAST(uid AS HUGEINT) * 10000000000 + CAST(k AS HUGEINT) * 1000000000 + s"))
    spans = (f"(SELECT x.uid, x.s, x.e, r.pseudonym FROM events x JOIN registry r ON x.rule = r.rule "
             f"AND {O.strip_sql('x.v')} = r.key JOIN U u ON u.uid = x.uid WHERE u.cell)")
    ctes.append(f"C AS (SELECT u.row, u.col, o.text FROM {O.splice_sql('(SELECT uid, text FROM U WHERE cell)', ['uid'], spans)} o "
                f"JOIN U u ON u.uid = o.uid WHERE u.row IS NOT NULL)")
    pivot = ", ".join(f"max(CASE WHEN col = '{c}' THEN text END) AS \"{c}\"" for c in STAFF_STR)
    return _with(ctes, f"""SELECT s.row, p."First Name", p."Last Name", p."Email", s."Balance" FROM staffs s
      LEFT JOIN (SELECT row, {pivot} FROM C GROUP BY row) p ON p.row = s.row""")


@register("workbook_sheets", _workbook_sql())
def workbook_sheets(spark, d):
    sheets = staff_sheets(spark, d)
    parts = mask_workbook([(df, "row") for _, df in sheets], rules=_rules(), multi_col_names=True)
    out = parts[0].masked
    for p in parts[1:]:
        out = out.unionByName(p.masked)
    return out


# ── S6: containers nested to any depth ──────────────────────────────────────

from ..sources.containers import container_paths  # noqa: E402
from ..sources.fixtures import SPARSE_SQL, container_nodes, container_nodes_sql, sparse_units  # noqa: E402


def _container_sql() -> str:
    rules = _rules("id")
    ids = ["file", "unit_seq"]
    ctes, last = O.kept(rules, "U", ids)
    walk = [f"N AS {container_nodes_sql()}",
            "W AS (SELECT file, id, text, [kind, row::BIGINT] AS path FROM N WHERE parent IS NULL "
            "UNION ALL SELECT n.file, n.id, n.text, list_concat(w.path, [n.kind, n.row::BIGINT]) FROM N n JOIN W w ON n.parent = w.id AND n.file = w.file)",
            "U AS (SELECT file, id AS unit_seq, text, row_number() OVER (PARTITION BY file ORDER BY path) AS place FROM W WHERE text IS NOT NULL)"]
    placed = f"KB AS (SELECT x.*, u.place FROM {last} x JOIN U u USING (file, unit_seq))"
    registry = "registry AS " + O.registry_sql(rules, "KB", ["file"], "CAST(place AS BIGINT) * 10000000000 + CAST(k AS BIGINT) * 1000000000 + s")
    return _splice_docs_sql([*walk, *ctes, placed, registry], last, "U", ids, ["file"]).replace("WITH ", "WITH RECURSIVE ", 1)


@register("container_walk", _container_sql())
def container_walk(spark, d):
    """Numbers follow the walk through the containers, not the ids."""
    nodes = container_nodes(spark, d)
    units = container_paths(nodes, ["file"], "id", "parent", ["kind", "row"], wanted="text IS NOT NULL").withColumnRenamed("id", "unit_seq")
    r = mask(units, "text", ["unit_seq"], ["file"], rules=_rules("id"), order_col="path")
    return r.masked.select("file", "unit_seq", "text")


# ── S4, S7: marked-up documents by kind, there and back; D7: blank units ────

from .jobs import mask_kind, restore_kind  # noqa: E402


@register("restore_nodes", "SELECT page_id, html FROM pages")
def restore_nodes(spark, d):
    pages = table(spark, d, "pages").select("page_id", "html")
    masked, r = mask_kind(pages, "nodes", key_cols=["page_id"], text_col="html", scope_cols=["page_id"], proper_nouns=True)
    masked = checkpointed(masked)  # read for its nodes and for the markup between them
    return restore_kind(masked, "nodes", key_cols=["page_id"], text_col="html", mapping=r.mapping, scope_cols=["page_id"])


_BC, _BL = _registry_ctes(_rules(), "B", ["unit_seq"], [], "CAST(unit_seq AS BIGINT) * 10000000000 + CAST(k AS BIGINT) * 1000000000 + s")


@register("blank_units", _splice_docs_sql([f"B AS {SPARSE_SQL}", *_BC], _BL, "B", ["unit_seq"], []))
def blank_units(spark, d):
    return mask(sparse_units(spark, d), "text", ["unit_seq"], None, rules=_rules()).masked


# ── D2: entities from a tagger that runs in the tasks ───────────────────────

from ..operators.tagging import tag_entities  # noqa: E402
from ..sources.fixtures import DICTIONARY, dictionary_tagger  # noqa: E402


def _tagged_sql() -> str:
    label = " ".join(f"WHEN '{w}' THEN '{x}'" for w, x in DICTIONARY.items())
    any_case = "|".join("".join(f"[{c.upper()}{c}]" for c in w) for w in DICTIONARY)
    return f"SELECT doc_id, s, e, CASE lower(v) {label} END AS label FROM {O.run_spans(DOCS, ['doc_id'], any_case)}"


@register("tagged_spans", _tagged_sql())
def tagged_spans(spark, d):
    return tag_entities(_docs(spark, d), dictionary_tagger, ["doc_id"], "text")


# ── D6: flags of a rule: MULTILINE, VERBOSE and ASCII ───────────────────────

_LINE_WORD = rule("line_word", "W{n}", r"^ [a-z]+ \b  # first word of a line", regex_flags=["MULTILINE", "VERBOSE", "ASCII"])


@register("spans_flags", r"""WITH L AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
  P AS (SELECT doc_id, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS INTEGER) AS s FROM L)
  SELECT doc_id, s, CAST(s + length(v) AS INTEGER) AS e, v FROM (SELECT doc_id, s, regexp_extract(line, '^[a-z]+\b') AS v FROM P) WHERE v <> ''""")
def spans_flags(spark, d):
    return _cands(_docs(spark, d), [_LINE_WORD], ["doc_id"])
