"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
CHECKED = [
    "budget_filter",
    "column_profile_whole",
    "column_prevalence_documents",
    "token_stats",
    "uv_findings_events",
    "truth_check",
    "uv_findings_other_lake",
    "fd_findings_other_lake",
    "scan_catalog",
    "fd_measures_whole",
    "no_measures_whole",
    "se_measures_dimensions",
    "se_measures_conversations",
    "se_labelled",
    "csv_tokens",
    "parquet_cells",
    "rejected_files",
    "model_incremental",
    "tokens_merged",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF_DIR)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = [tuple(plain(row[names.index(c)]) for c in df.columns) for row in result.fetchall()]
    found = [tuple(plain(v) for v in row) for row in df.collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert found


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_long_columns_agree_with_sql_whatever_the_limit(spark, duck, monkeypatch):
    """All columns through the ways for long columns, none compared inside one row."""
    from tablewarden.operators import spelling

    monkeypatch.setattr(spelling, "SHORT_COLUMN", 1)
    test_query_equals_its_sql(spark, duck, "se_pairs")
