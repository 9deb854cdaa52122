"""Tables derived by Spark from the given test tables.

The test tables hold no ids or usernames and no split name columns, so these
derivations (each the same expression in Spark and in the SQL oracle) give the
rules work that grows with the input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name lists for the derived split-name staff table (our own fixture data).
FIRST_NAMES = ["Alice", "Bob", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi", "Ivan", "Judy", "Mallory"]
LAST_NAMES = ["Johnson", "Smith", "Brown", "Taylor", "Wilson", "Davies", "Evans", "Thomas", "Roberts",
              "Walker", "Wright", "Green", "Hall"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per order; hits every default rule (the e-mail's 8-digit local
    part is an id candidate that must lose to the e-mail)."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(
        F.lit("Order "), (F.col("o_orderkey") + 10000000).cast("string"), F.lit(" by "),
        (F.col("o_custkey") + 10000000).cast("string"), F.lit("@mail.example.com login ab"),
        F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(" Jane Clerk agreed"))
    return o.select((F.col("o_orderkey") + 1000000).alias("unit_seq"), F.col("o_orderdate"), text.alias("text"))


ORDER_UNITS_SQL = """(SELECT o_orderkey + 1000000 AS unit_seq, o_orderdate,
  'Order ' || CAST(o_orderkey + 10000000 AS VARCHAR) || ' by ' || CAST(o_custkey + 10000000 AS VARCHAR)
  || '@mail.example.com login ab' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') || ' Jane Clerk agreed' AS text
  FROM orders)"""


def staff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide table with names split over columns, from ``customer``."""
    c = table(spark, sf_dir, "customer")
    first = F.array(*[F.lit(x) for x in FIRST_NAMES])
    last = F.array(*[F.lit(x) for x in LAST_NAMES])
    fi = F.pmod(F.col("c_custkey"), F.lit(len(FIRST_NAMES)))
    li = F.pmod(F.col("c_custkey") * 7 + F.floor(F.col("c_custkey") / 3), F.lit(len(LAST_NAMES)))
    fn = F.element_at(first, (fi + 1).cast("int"))
    # every fourth customer gets a surname of its own (an unambiguous component)
    own = F.concat(F.lit("Q"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    ln = F.when(F.pmod(F.col("c_custkey"), F.lit(4)) == 1, own).otherwise(F.element_at(last, (li + 1).cast("int")))
    email = F.concat(F.lower(fn), F.lit("."), F.lower(ln), F.col("c_custkey").cast("string"), F.lit("@uni.ac.uk"))
    return c.select(F.col("c_custkey").alias("row"), fn.alias("First Name"), ln.alias("Last Name"),
                    email.alias("Email"), F.col("c_acctbal").alias("Balance"))


def staff_sql() -> str:
    first = ", ".join(f"'{x}'" for x in FIRST_NAMES)
    last = ", ".join(f"'{x}'" for x in LAST_NAMES)
    fn = f"[{first}][(c_custkey % {len(FIRST_NAMES)}) + 1]"
    ln = (f"CASE WHEN c_custkey % 4 = 1 THEN 'Q' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') "
          f"ELSE [{last}][((c_custkey * 7 + floor(c_custkey / 3)::BIGINT) % {len(LAST_NAMES)}) + 1] END")
    return (f"(SELECT c_custkey AS row, {fn} AS \"First Name\", {ln} AS \"Last Name\", "
            f"lower({fn}) || '.' || lower({ln}) || CAST(c_custkey AS VARCHAR) || '@uni.ac.uk' AS \"Email\", "
            f"c_acctbal AS \"Balance\" FROM customer)")


NAME_SHAPE = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+(?:[ ]+[A-Z][a-z]+)+(?![\p{L}\p{N}_])"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NER-like entities from ``documents``: every run of 2+ Title-Case words
    (ASCII spaces), labelled PERSON for even ``doc_id`` and GPE for odd."""
    from ..operators.spans import _offsets, _pieces

    d = table(spark, sf_dir, "documents")
    spans = F.when(F.col("text").isNull(), F.array().cast("array<struct<s:int,e:int,k:int,v:string>>")).otherwise(
        _offsets(_pieces(F.col("text"), "(?d)" + NAME_SHAPE), 0))
    label = F.when(F.pmod(F.col("doc_id"), F.lit(2)) == 0, F.lit("PERSON")).otherwise(F.lit("GPE"))
    return (d.select("doc_id", label.alias("label"), F.explode_outer(spans).alias("h")).where(F.col("h").isNotNull())
            .select("doc_id", F.col("h.s").alias("s"), F.col("h.e").alias("e"), "label",
                    F.col("h.v").alias("text")))


def event_units(df: DataFrame) -> DataFrame:
    """Units from ``events`` rows: the user id as a 7-digit account number."""
    text = F.concat(F.lit("account "), (F.col("user_id") + 1000000).cast("string"), F.lit(" "), F.col("event_type"))
    return df.select(F.col("event_id").alias("unit_seq"), "ts", text.alias("text"))


# NI-number letter pairs for the contact fixture (mixed case on purpose).
NI_PREFIXES = ["AB", "ce", "HJ", "pr", "Tw"]


def contact_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit per customer with a national-insurance-like number, a UK-style
    phone number and a postcode (for the example detector set)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    ni = F.concat(F.element_at(F.array(*[F.lit(x) for x in NI_PREFIXES]), (F.pmod(k, F.lit(5)) + 1).cast("int")),
                  F.lpad(F.pmod(k * 7919, F.lit(1000000)).cast("string"), 6, "0"),
                  F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (F.pmod(k, F.lit(4)) + 1).cast("int")))
    phone = F.concat(F.lit("07700 "), F.lpad(F.pmod(k * 13, F.lit(1000000)).cast("string"), 6, "0"))
    pc = F.concat(F.lit("SW"), (F.pmod(k, F.lit(9)) + 1).cast("string"), F.lit("A "),
                  (F.pmod(k, F.lit(7)) + 1).cast("string"), F.lit("AB"))
    pc = F.when(F.pmod(k, F.lit(2)) == 1, F.lower(pc)).otherwise(pc)
    text = F.concat(F.lit("Customer "), F.col("c_name"), F.lit(" NI "), ni, F.lit(" tel "), phone, F.lit(" post "), pc)
    return c.select(k.alias("unit_seq"), text.alias("text"))


def contact_units_sql() -> str:
    pref = ", ".join(f"'{x}'" for x in NI_PREFIXES)
    ni = (f"[{pref}][(c_custkey % 5) + 1] || lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') "
          f"|| ['A', 'B', 'C', 'D'][(c_custkey % 4) + 1]")
    phone = "'07700 ' || lpad(CAST((c_custkey * 13) % 1000000 AS VARCHAR), 6, '0')"
    pc = "'SW' || CAST(c_custkey % 9 + 1 AS VARCHAR) || 'A ' || CAST(c_custkey % 7 + 1 AS VARCHAR) || 'AB'"
    pc = f"CASE WHEN c_custkey % 2 = 1 THEN lower({pc}) ELSE {pc} END"
    return (f"(SELECT c_custkey AS unit_seq, 'Customer ' || c_name || ' NI ' || {ni} || ' tel ' || {phone} "
            f"|| ' post ' || {pc} AS text FROM customer)")


def staff_sheets(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The staff table as a workbook: one sheet per market segment, in name order."""
    seg = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), "c_mktsegment")
    st = staff(spark, sf_dir).join(seg, "row")
    names = sorted(r[0] for r in seg.select("c_mktsegment").distinct().collect())  # a handful of segments
    return [(s, st.where(F.col("c_mktsegment") == s).drop("c_mktsegment")) for s in names]


def container_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of nested containers, one file per customer: an order
    holds a paragraph and a cell per line number, a cell a paragraph per part and
    a nested cell per supplier, that one a paragraph.  ``text`` is null for
    containers."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"))
    lines = (table(spark, sf_dir, "lineitem")
             .select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("line"), "l_partkey", "l_suppkey").join(orders, "k"))
    key, no = F.col("k").cast("string"), lambda c: (F.col(c) + 1000000).cast("string")
    cell = F.concat_ws("/", key, "line")
    part, supplier = F.concat(cell, F.lit("/p"), F.col("l_partkey")), F.concat(cell, F.lit("/s"), F.col("l_suppkey"))
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("string")

    def nodes(df, node_id, parent, kind, row, text):
        return df.select("file", node_id.alias("id"), parent.alias("parent"), F.lit(kind).alias("kind"), row.alias("row"), text.alias("text"))

    of_line = lines.select("file", "k", "line").distinct()
    of_supplier = lines.select("file", "k", "line", "l_suppkey").distinct()
    return (nodes(orders, key, none, 1, F.col("k"), none)
            .unionByName(nodes(orders, F.concat(key, F.lit("/o")), key, 0, zero, F.concat(F.lit("order "), no("k"))))
            .unionByName(nodes(of_line, cell, key, 1, F.col("line"), none))
            .unionByName(nodes(lines.select("file", "k", "line", "l_partkey").distinct(), part, cell, 0, F.col("l_partkey"),
                               F.concat(F.lit("part "), no("l_partkey"))))
            .unionByName(nodes(of_supplier, supplier, cell, 1, F.col("l_suppkey"), none))
            .unionByName(nodes(of_supplier, F.concat(supplier, F.lit("/t")), supplier, 0, zero, F.concat(F.lit("supplier "), no("l_suppkey")))))


def container_nodes_sql() -> str:
    line = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    cell = "o_orderkey || '/' || l_linenumber"
    return f"""(SELECT o_custkey AS file, CAST(o_orderkey AS VARCHAR) AS id, NULL::VARCHAR AS parent, 1 AS kind, o_orderkey AS row, NULL AS text FROM orders
  UNION ALL SELECT o_custkey, o_orderkey || '/o', CAST(o_orderkey AS VARCHAR), 0, 0, 'order ' || (o_orderkey + 1000000) FROM orders
  UNION ALL SELECT DISTINCT o_custkey, {cell}, CAST(o_orderkey AS VARCHAR), 1, l_linenumber, NULL {line}
  UNION ALL SELECT DISTINCT o_custkey, {cell} || '/p' || l_partkey, {cell}, 0, l_partkey, 'part ' || (l_partkey + 1000000) {line}
  UNION ALL SELECT DISTINCT o_custkey, {cell} || '/s' || l_suppkey, {cell}, 1, l_suppkey, NULL {line}
  UNION ALL SELECT DISTINCT o_custkey, {cell} || '/s' || l_suppkey || '/t', {cell} || '/s' || l_suppkey, 0, 0, 'supplier ' || (l_suppkey + 1000000) {line})"""


def sparse_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers between units that are null, empty or blank."""
    o = table(spark, sf_dir, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    text = (F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, " \t\n")
            .otherwise(F.concat(F.lit("  order "), (F.col("o_orderkey") + 1000000).cast("string"))))
    return o.select(F.col("o_orderkey").cast("bigint").alias("unit_seq"), text.cast("string").alias("text"))


SPARSE_SQL = """(SELECT o_orderkey::BIGINT AS unit_seq, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ''
  WHEN 2 THEN ' ' || chr(9) || chr(10) ELSE '  order ' || CAST(o_orderkey + 1000000 AS VARCHAR) END AS text FROM orders)"""


#: entries of the dictionary tagger (our own fixture data)
DICTIONARY = {"the": "EN", "which": "EN", "der": "DE", "und": "DE", "que": "ES", "dans": "FR"}


def dictionary_tagger():
    """A tagger that labels whole words of ``DICTIONARY``, upper and lower case alike."""
    import re

    words = re.compile(r"\w+")

    def tag(texts):
        return [[(m.start(), m.end(), DICTIONARY[w]) for m in words.finditer(t) if (w := m[0].lower()) in DICTIONARY] for t in texts]

    return tag
