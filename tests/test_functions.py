import pytest
from pyspark.sql import functions as F

from tablewarden.functions.buckets import prevalence_range, rows_range, token_length_range
from tablewarden.functions.scores import better_ratio, label_error, likelihood_ratio, natural_log
from tablewarden.functions.text import (
    file_stem,
    float_text,
    is_alnum,
    is_numeric_text,
    mean_difference_length,
    number,
    tokens,
)
from tablewarden.operators import tokens as token_counts
from tablewarden.session import stage


def apply(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_buckets(spark):
    assert apply(spark, [0, 20, 21, 50, 51, 100, 101, 500, 501, 1000, 1001], "long", rows_range) == [
        0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5,
    ]
    assert apply(spark, [5.0, 5.1, 10.0, 15.0, 20.0, 20.5, None], "double", token_length_range) == [
        0, 1, 1, 2, 3, 4, None,
    ]
    assert apply(spark, [50.0, 100.0, 1e3, 1e4, 1e5, 1e6], "double", prevalence_range) == list(range(6))


@pytest.mark.parametrize(
    "x", [1.5, 1e7, 123456789.25, 0.1, 1e-4, 1e-5, 1.5e-7, 1e16, 1.25e22, 1e100, 2.5e-120, -3.25, 100.0, 1e15, 0.001]
)
def test_float_text_is_the_shortest_decimal(spark, x):
    assert apply(spark, [x], "double", float_text) == [repr(x)]


def test_float_text_special(spark):
    values = [-0.0, float("nan"), None, float("inf")]
    assert apply(spark, values, "double", float_text) == ["0.0", None, None, "inf"]


def test_number(spark):
    values = ["12", "12d", "1.5e3", "-.5", "", "abc", "1.", "inf", None, "1 "]
    assert apply(spark, values, "string", number) == [
        12.0, None, 1500.0, -0.5, None, None, 1.0, float("inf"), None, None,
    ]


def test_text_predicates(spark):
    values = ["abc1", "é9", "a b", "", "-1", "1.0", "12", "ab\n"]
    assert apply(spark, values, "string", is_alnum) == [v.isalnum() for v in values]
    assert apply(spark, values, "string", is_numeric_text) == [v.isnumeric() for v in values]


def test_tokens(spark):
    values = ["", " a  b\tc ", "x y", "one　two\x1cthree", "\n"]
    assert apply(spark, values, "string", tokens) == [v.split() for v in values]


def test_tokens_of_texts_with_and_without_rare_spaces(spark):
    values = ["", " ", "a", "é\n b", "\n\n", " a  b ", "a\tb c", "a\u00a0b", "größe x\u2003y\nz", "a\x1fb", None]
    assert apply(spark, values, "string", tokens) == [None if v is None else v.split() for v in values]


def test_token_difference(spark):
    df = spark.createDataFrame([("a bb c", "a ddd c"), ("a b", "b a"), ("", "abc")], "a string, b string")
    found = df.select(mean_difference_length(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in found] == [2.5, 0.0, 3.0]


def test_scores(spark):
    assert apply(spark, [0.0, 1.0, -1.0], "double", natural_log) == [float("-inf"), 0.0, None]
    assert apply(spark, [2, 1, 0, None], "int", label_error) == [1, 0, -1, -1]
    df = spark.createDataFrame([(1, 2), (1, 0)], "a long, b long")
    ratio = likelihood_ratio(F.col("a"), F.col("b"))
    assert [r[0] for r in df.select(ratio).collect()] == [0.5, None]
    assert [r[0] for r in df.select(better_ratio(ratio, F.lit(0.7))).collect()] == [0.7, 0.7]


def test_file_stem(spark):
    assert apply(spark, ["/a/b/c.csv", "x.tar.gz", "plain"], "string", file_stem) == ["c", "x.tar", "plain"]


def test_means_read_the_tokens_once(spark, monkeypatch):
    """Counts per table are written down before they are both counted and added up."""
    staged = []
    monkeypatch.setattr(token_counts, "stage", lambda df, name: staged.append(name) or stage(df, name))
    per_table = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("b", "y", 1)], "table_id string, token string, cnt long")
    found = {r.token: r.cnt for r in token_counts.lake_token_means(per_table).collect()}
    assert found == {"x": 1.5, "y": 0.5} and staged == ["table_tokens"]
