import random
from math import inf, isinf, nan

import pytest
from pyspark.sql import functions as F

from tablewarden.operators.spelling import spelling_measures
from tablewarden.operators.types import column_types
from tablewarden.plans.measures import Measured
from tablewarden.sources.files import retyped
from tests import brute


def close(a, b):
    return a == b or (a is not None and b is not None and not isinf(a) and abs(a - b) <= 1e-9 * max(1, abs(b)))


def by_column(df, *fields):
    return {(r.table_id, r.col_idx): tuple(r[f] for f in fields) for r in df.collect()}


def uv(spark, tables):
    return by_column(Measured(brute.make_lake(spark, tables)).uv(), "ur", "ur_p", "suspect_row")


def fd(spark, tables):
    measures = Measured(brute.make_lake(spark, tables)).fd()
    return {
        (r.table_id, r.col_1_idx, r.col_2_idx): (r.fd, r.fd_p, r.suspect_row) for r in measures.collect()
    }


def no(spark, tables):
    measures = Measured(brute.make_lake(spark, tables, "float64")).no()
    return by_column(
        measures, "max_mad", "max_mad_p", "suspect_row", "max_mad_log", "max_mad_log_p"
    )


def se(spark, tables, short):
    m = Measured(brute.make_lake(spark, tables))
    found = spelling_measures(m.values, m.profile, m.sizes.n_texts, short=short)
    return by_column(found, "mpd", "mpd_p", "suspect_row", "range_mpd")


def test_uniqueness_fixtures(spark):
    found = uv(
        spark,
        {
            "dup_first_row": [["a", "b", "a"]],
            "all_unique": [["a", "b", "c"]],
            "all_missing": [[None, None]],
            "missing_and_nan": [["nan", None, "x", None]],
        },
    )
    assert found["dup_first_row", 0] == (2 / 3, 1.0, 0)
    assert found["all_unique", 0] == (1.0, 1.0, None)
    assert found["all_missing", 0] == (None, None, None)
    assert found["missing_and_nan", 0] == (1.0, 1.0, None)


def test_dependency_fixtures(spark):
    found = fd(
        spark,
        {
            "one": [["a", "a", "a", "b"], ["1", "1", "2", "3"]],
            "all": [["a", "a"], ["1", "2"]],
            "missing": [["a", "a", "b"], ["1", None, "3"]],
            "constant": [["a", "a", "b"], ["1", "1", "1"]],
            "no_determinant": [[None, None], ["1", "2"]],
        },
    )
    assert found["one", 0, 1] == (1 / 4, 2 / 3, 2)
    assert found["all", 0, 1] == (-1.0, -1.0, None)
    assert found["missing", 0, 1] == (1 / 3, 1.0, 1)
    assert found["constant", 0, 1] == (2 / 3, 2 / 3, None)
    assert found["no_determinant", 0, 1] == (-1.0, -1.0, None)


def test_outlier_fixtures(spark):
    found = no(
        spark,
        {
            "mad_zero": [["1", "1", "1", "9"]],
            "mad_outlier": [["1", "2", "3", "4", "100"]],
            "log_zero": [["0", "0", "0", "5"]],
        },
    )
    assert ("mad_zero", 0) not in found and ("log_zero", 0) not in found
    assert found["mad_outlier", 0][0] == 97 and found["mad_outlier", 0][2] == 4


@pytest.mark.parametrize("short", [64, 0])
def test_spelling_fixtures(spark, short):
    found = se(
        spark,
        {
            "typo": [["london", "londom", "paris"]],
            "duplicates": [["cat", "cat", "cot"]],
            "order": [["a b", "b a"]],
            "single": [["a", "a"]],
            "missing": [["nab", None, "xxxxxx"]],
        },
        short,
    )
    assert found["typo", 0] == (1, 6, 0, 1)
    assert found["duplicates", 0] == (1, inf, 2, 0)
    assert ("order", 0) not in found and ("single", 0) not in found
    assert found["missing", 0] == (1, 6, 0, 0)  # `nab` and the text `nan` of a missing cell


def random_tables(count, cell, seed, width=1, rows=(1, 9)):
    rng = random.Random(seed)
    tables = {}
    for t in range(count):
        n = rng.randint(*rows)
        tables[f"t{t}"] = [[cell(rng) for _ in range(n)] for _ in range(width)]
    return tables


def letter(rng):
    return rng.choice(["a", "b", "c", "d", None])


def numeral(rng):
    return rng.choice(["0.0", "1.0", "2.0", "2.5", "-3.0", "7.0", "100.0", "1e-05", None])


def word(rng):
    return "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) + rng.choice(["", " x", " yy"])


@pytest.fixture(params=["window", "ranges"])
def strategy(request):
    if request.param == "ranges":
        request.getfixturevalue("wide")


def test_uniqueness_random(spark):
    tables = random_tables(200, letter, 1)
    found = uv(spark, tables)
    for t, (column,) in tables.items():
        assert found[t, 0] == brute.uniqueness(column), column


def test_dependency_random(spark, strategy):
    tables = random_tables(60, letter, 2, width=3)
    found = fd(spark, tables)
    for t, columns in tables.items():
        for i, j in ((0, 1), (0, 2), (1, 2)):
            expected = brute.compliance(columns[i], columns[j])
            assert found[t, i, j] == expected, (columns[i], columns[j])


def test_outlier_random(spark, strategy):
    tables = random_tables(150, numeral, 4, rows=(1, 12))
    found = no(spark, tables)
    for t, (column,) in tables.items():
        numbers = [nan if c is None else float(c) for c in column]
        raw = brute.outlier(numbers)
        if raw is None:
            assert (t, 0) not in found
            continue
        log = brute.outlier(brute.logs(numbers)) or (inf, inf, None)
        expected = (*raw, *log[:2])
        assert all(close(a, b) for a, b in zip(found[t, 0], expected)), (column, found[t, 0], expected)


@pytest.mark.parametrize("short", [64, 2, 0])
def test_spelling_random(spark, short):
    from tablewarden.functions.buckets import TOKEN_LENGTH_BOUNDS

    tables = random_tables(120, word, 5, rows=(1, 10))
    found = se(spark, tables, short)
    for t, (column,) in tables.items():
        expected = brute.spelling(column)
        if expected is None:
            assert (t, 0) not in found, column
            continue
        bucket = sum(expected[3] > b for b in TOKEN_LENGTH_BOUNDS)
        assert found[t, 0] == (*expected[:3], bucket), column


def test_spelling_of_long_texts_and_wide_groups(spark, wide):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdef ") for _ in range(90))

    def edited(text, times):
        for _ in range(times):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + "z" + text[at:], text[:at] + "q" + text[at + 1 :]])
        return text

    tables = {f"t{k}": [[edited(base, rng.choice([0, 1, 2, 5, 30])) for _ in range(7)]] for k in range(25)}
    tables["edge"] = [["x" * 64, "x" * 65, "y" * 70]]
    found = se(spark, tables, 0)
    for t, (column,) in tables.items():
        expected = brute.spelling(column)
        if expected is None:
            assert (t, 0) not in found
        else:
            assert found[t, 0][:3] == expected[:3], (t, column)


def test_budget_leaves_out_large_tables(spark, strategy):
    tables = {"small": [["1", "2", "9"]], "large": [[str(i * i) for i in range(40)]]}
    lake = brute.make_lake(spark, tables, "int64")
    assert {r.table_id for r in Measured(lake, n_cells_limit=10).no().collect()} == {"small"}
    assert {r.table_id for r in Measured(lake).no().collect()} == {"small", "large"}


def test_prevalence(spark):
    from tablewarden.operators.tokens import column_prevalence

    lake = brute.make_lake(spark, {"t": [["a a b", "c", "", None], ["x", "x", "x", "x"]]})
    counts = spark.createDataFrame([("a", 10), ("b", 20), ("nan", 7)], "token string, cnt long")
    values = Measured(lake).values
    found = by_column(column_prevalence(values, counts), "prevalence", "avg_col_pre")
    assert found["t", 0] == (15 + 1 + 0 + 7, 0) and found["t", 1] == (4.0, 0)
    mean = by_column(column_prevalence(values, counts, "mean"), "prevalence")
    assert mean["t", 0] == (23 / 4,)


def test_types_are_inferred_from_texts(spark):
    columns = {
        "int": ["1", "-2"],
        "float": ["1", None],
        "real": ["1.5", "2"],
        "bool": ["True", "False"],
        "text": ["12d", "1"],
        "empty": [None, None],
    }
    lake = brute.make_lake(spark, {k: [v] for k, v in columns.items()})
    found = {r.table_id: (r.base_type, r.n_rows) for r in column_types(lake.rows).collect()}
    kinds = {"int": "int64", "float": "float64", "real": "float64", "bool": "bool", "text": "object", "empty": "float64"}
    assert found == {k: (kind, 2) for k, kind in kinds.items()}
    typed = {r.table_id: (r.base_type, r.d_type) for r in Measured(retyped(lake)).profile.collect()}
    assert typed["int"] == ("int64", "int64") and typed["float"][0] == "float64"
    assert typed["bool"] == ("bool", "alnumeric") and typed["text"] == ("object", "alnumeric")


def test_suspects_of_a_hot_table_survive_any_strategy(spark, wide):
    """One table with most rows, most of them one value."""
    n = 200
    column = ["v"] * (n - 2) + ["w", "u"]
    other = [str(i % 3) for i in range(n)]
    found = fd(spark, {"hot": [column, other], "cold": [["a", "a"], ["1", "1"]]})
    assert found["hot", 0, 1] == brute.compliance(column, other)
    assert found["cold", 0, 1] == brute.compliance(["a", "a"], ["1", "1"])
