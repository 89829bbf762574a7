"""Column profiles: counts, types, features and the uniqueness measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.buckets import rows_range
from tablewarden.functions.text import is_alnum, is_numeric_text
from tablewarden.sources.lake import Lake

COLUMN_KEY = ["table_id", "col_idx"]


def profile(lake: Lake, values: DataFrame) -> DataFrame:
    """One row per column.

    Counts (n_rows, n_present, n_distinct, n_texts), types (base_type, d_type), features
    (rows_range), the uniqueness ratio before and after dropping the first duplicate (ur, ur_p),
    and the row of that duplicate (dup_row), NULL if there is none.

    The ratio after the drop needs no second pass: dropping one of several equal rows leaves the
    number of distinct values as it is. Every aggregate has a fixed-width state, so the whole
    profile is one hash aggregation.
    """
    present = F.col("n") - F.col("n_missing")
    real = present > 0

    found = values.groupBy(*COLUMN_KEY).agg(
        F.sum("n").alias("n_rows"),
        F.sum("n_missing").alias("n_missing"),
        F.sum(present).alias("n_present"),
        F.count_if(real).alias("n_distinct"),
        F.count(F.lit(1)).alias("n_texts"),
        F.bool_and(is_alnum(F.col("text"))).alias("alnum"),
        F.bool_and(F.when(is_alnum(F.col("text")), is_numeric_text(F.col("text"))).otherwise(False)).alias("numeric_text"),
        F.min(F.when(present > 1, F.col("first_present"))).alias("dup_row"),
    )
    typed = lake.with_columns(found, "base_type")
    ur = F.try_divide("n_distinct", "n_present")
    return typed.select(
        *COLUMN_KEY,
        "n_rows",
        "n_present",
        "n_distinct",
        "n_texts",
        "alnum",
        "numeric_text",
        "base_type",
        F.when(F.col("alnum"), "alnumeric").otherwise(F.col("base_type")).alias("d_type"),
        rows_range(F.col("n_present")).alias("rows_range"),
        ur.alias("ur"),
        F.when(F.col("dup_row").isNull(), ur)
        .otherwise(F.try_divide(F.col("n_distinct"), F.col("n_present") - 1))
        .alias("ur_p"),
        "dup_row",
    )


def table_catalog(profiled: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_cols, n_cells) of every table."""
    sized = profiled.groupBy("table_id").agg(
        F.max("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_cols")
    )
    return sized.withColumn("n_cells", F.col("n_rows") * F.col("n_cols"))


def within_budget(catalog: DataFrame, n_cells_limit: int) -> DataFrame:
    """Tables with fewer cells than the limit."""
    return catalog.filter(F.col("n_cells") < n_cells_limit)
