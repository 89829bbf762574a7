"""Token frequencies of a lake and the prevalence of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.buckets import prevalence_range
from tablewarden.functions.text import MISSING_TEXT, is_one_token, tokens
from tablewarden.operators.profile import COLUMN_KEY
from tablewarden.session import stage


def table_tokens(values: DataFrame) -> DataFrame:
    """(table_id, token, cnt): occurrences per table, from distinct texts times their counts."""
    return (
        values.select("table_id", "n", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("table_id", "token")
        .agg(F.sum("n").alias("cnt"))
    )


def cell_tokens(rows: DataFrame) -> DataFrame:
    """(table_id, token, cnt) straight from rows of texts, where no value dictionary is wanted for more."""
    text = F.coalesce("value", F.lit(MISSING_TEXT))
    cells = rows.select("table_id", F.explode("cells").alias("value"))
    found = cells.select("table_id", F.explode(tokens(text)).alias("token"))
    return found.groupBy("table_id", "token").agg(F.count(F.lit(1)).alias("cnt"))


def lake_tokens(values: DataFrame) -> DataFrame:
    """(token, cnt): occurrences in the whole lake, without counts per table on the way."""
    return (
        values.select("n", F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("token")
        .agg(F.sum("n").alias("cnt"))
    )


def merged_tokens(per_table: DataFrame) -> DataFrame:
    """(token, cnt): the sum of counts per table, such as ones written earlier."""
    return per_table.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def token_stats(per_table: DataFrame) -> DataFrame:
    """One row: tables with tokens, and the sum of their numbers of distinct tokens."""
    sizes = per_table.groupBy("table_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_tables"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_entries")
    )


def lake_token_means(per_table: DataFrame, n_tables: int | None = None) -> DataFrame:
    """(token, cnt): occurrences divided by the number of tables."""
    if n_tables is None:
        per_table = stage(per_table, "table_tokens")  # read twice
        n_tables = token_stats(per_table).first()["n_tables"]
    return merged_tokens(per_table).select(
        "token", (F.col("cnt").cast("double") / F.lit(n_tables)).alias("cnt")
    )


def column_prevalence(values: DataFrame, token_counts: DataFrame, mode: str = "sum") -> DataFrame:
    """(table_id, col_idx, prevalence, avg_col_pre) of every column.

    The prevalence of a text is the mean count of its distinct tokens, 1 for unknown tokens and 0
    for a text without tokens; a column's is the sum over its rows, or the mean with mode="mean".
    Weights of long texts are first summed per column and token, so a token that fills a column
    meets the dictionary once per column, not once per text.
    """
    if mode not in ("sum", "mean"):
        raise ValueError("mode must be 'sum' or 'mean'")
    # A text of one token is one row per column already; only tokens of longer texts are added up.
    one = is_one_token(F.col("text"))
    split = values.filter(~one).select(*COLUMN_KEY, "n", F.array_distinct(tokens(F.col("text"))).alias("tokens"))
    weights = (
        split.select(
            *COLUMN_KEY,
            F.explode("tokens").alias("token"),
            (F.col("n") / F.size("tokens")).alias("weight"),
        )
        .groupBy(*COLUMN_KEY, "token")
        .agg(F.sum("weight").alias("weight"))
        .union(
            values.filter(one).select(*COLUMN_KEY, F.col("text").alias("token"), F.col("n").cast("double").alias("weight"))
        )
    )
    summed = (
        weights.join(token_counts, "token", "left")
        .groupBy(*COLUMN_KEY)
        .agg(F.sum(F.col("weight") * F.coalesce("cnt", F.lit(1))).alias("sum"))
    )
    # Columns whose texts have no tokens at all are only in `values`.
    counted = values.groupBy(*COLUMN_KEY).agg(F.sum("n").alias("n_rows"))
    total = F.round(F.coalesce("sum", F.lit(0.0)), 6)
    per_column = counted.join(summed, COLUMN_KEY, "left")
    prevalence = total if mode == "sum" else F.round(total / F.col("n_rows"), 6)
    return per_column.select(
        *COLUMN_KEY,
        prevalence.alias("prevalence"),
        prevalence_range(prevalence).alias("avg_col_pre"),
    )
