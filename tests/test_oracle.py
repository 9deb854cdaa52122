"""Registered queries against their DuckDB SQL on the smallest tables (the
full set runs with ``tools/check_oracle.py``)."""

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E
from tools.check_oracle import TABLES, digest

NAMES = ["masked_docs", "registry_orders", "resolve_overlaps", "split_name_table", "workbook_sheets",
         "example_rules", "page_text", "fragment_merge", "template_render", "restore_modes"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    srows, drows = [tuple(r) for r in df.collect()], rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(rel.columns, drows)[0]
