"""A few registered queries against their SQL twins, and the entry contract."""

import math
import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

CHECKED = [
    "hdr5_header_decision", "src5_numeric_columns", "map6_resolve_mapping", "nrm12_statement_meta", "txt5_clean_description",
    "jon1_nearest_merchant", "jon8_categorize", "jon9_fuzzy_suggestions", "agg6_discover_entities", "val3_statements_to_ledger",
    "src4_quoted_line_breaks", "src6_header_only", "nrm8_spelled_dates", "jon9_name_inside_line", "udf3_encoder", "rvw3_review_round", "rvw4_completion",
    "knw3_learned_merchants", "cls1_cls2_regression_by_marker",
]


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return repr(v)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    result = sql.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([shown(row[names.index(c)]) for c in sorted(names)] for row in result.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
