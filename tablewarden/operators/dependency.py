"""Functional-dependency compliance of column pairs, before and after dropping the first violation.

For a pair (i, j) with i left of j, a determinant value is good if all its rows have one dependent
value. The ratio is (good values) / (rows with a determinant); the suspect is the first row that
contradicts the first row of its determinant value. Missing dependents equal nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.operators import ordered
from tablewarden.operators.contradictions import contradictions
from tablewarden.operators.joins import attach
from tablewarden.session import ship_package
from tablewarden.sources.lake import Lake

PAIR_KEY = ["table_id", "col_1_idx", "col_2_idx"]


def column_pairs(features: DataFrame) -> DataFrame:
    """Every pair of columns of a table, left to right, with what is known of both columns.

    `features` is a profile with avg_col_pre. Gathers one row per column, so a group is as large as
    a table is wide.
    """
    known = ["d_type", "rows_range", "avg_col_pre", "n_rows", "n_present", "n_distinct"]
    tables = features.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("col_idx", *known))).alias("columns")
    )
    left = tables.select("table_id", "columns", F.posexplode("columns").alias("at", "one"))
    both = left.select(
        "table_id",
        "one",
        F.explode(F.slice("columns", F.col("at") + 2, F.size("columns"))).alias("two"),
    )
    return both.select(
        "table_id",
        F.col("one.col_idx").alias("col_1_idx"),
        F.col("two.col_idx").alias("col_2_idx"),
        F.col("one.d_type").alias("d_type_1"),
        F.col("two.d_type").alias("d_type_2"),
        F.col("one.rows_range").alias("rows_range"),
        F.col("one.avg_col_pre").alias("avg_col_pre_1"),
        F.col("two.avg_col_pre").alias("avg_col_pre_2"),
        F.col("one.n_rows").alias("n_rows"),
        F.col("one.n_present").alias("n_present"),
        F.col("one.n_distinct").alias("n_distinct"),
        # No row can contradict another if the determinant never repeats or the dependent never changes.
        (
            (F.col("one.n_distinct") < F.col("one.n_present"))
            & ~((F.col("two.n_distinct") == 1) & (F.col("two.n_present") == F.col("two.n_rows")))
        ).alias("open"),
    )


def violations(lake: Lake, pairs: DataFrame, values: DataFrame, largest: int) -> DataFrame:
    """(pair key, violated, code) of the pairs with a violation.

    violated counts the determinant values with several dependent values. code is 2 * row + 1 if
    dropping that row repairs its determinant value and 2 * row if not, for the first violating row.

    Tables stay whole in one task while the largest has few enough pair cells; then no more than rows
    is shuffled. Pairs without a violation for the counts alone give no row either way. Beyond, pair cells are grouped wherever they lie.
    """
    if largest <= ordered.GROUP_LIMIT:
        return _violations_by_table(lake)
    return _violations_by_value(lake, pairs, values, largest)


def _hashes(salt: int) -> Column:
    """64 bits of each cell, NULL where it is missing."""
    return F.transform("cells", lambda c: F.when(c.isNotNull(), F.xxhash64(F.lit(salt), c)))


def _violations_by_table(lake: Lake) -> DataFrame:
    """Whole tables go through a task one after the other, as two hashes of each cell.

    Numbers of rows are sorted there, a chunk of tables at a time; sorted by Spark, a row for each cell
    that is a determinant would carry the hashes of all later cells, and spill.
    """
    ship_package(lake.rows.sparkSession)
    # 128 bits tell determinants apart; 64 are enough to compare a dependent with one other.
    hashed = lake.rows.filter(F.col("table_id").isNotNull() & (F.size("cells") > 1)).select(
        "table_id", F.col("row_idx").cast("long").alias("row_idx"), _hashes(0).alias("x"), _hashes(1).alias("y")
    )
    tables = hashed.repartition("table_id").sortWithinPartitions("table_id")
    return tables.mapInArrow(
        contradictions, "table_id string, col_1_idx int, col_2_idx int, violated long, code long"
    )


def _violations_by_value(lake: Lake, pairs: DataFrame, values: DataFrame, largest: int) -> DataFrame:
    """A row for each pair cell, grouped by both values before the shuffle.

    `values` is the lake's value dictionary: a determinant that occurs once makes no pair rows.
    """
    # A row per determinant column, so a list is as long as a table is wide at most.
    wanted = (
        pairs.filter("open")
        .groupBy("table_id", "col_1_idx")
        .agg(F.collect_list("col_2_idx").alias("others"), F.max("n_rows").alias("n_rows"))
    )
    # Every text is hashed once to 128 bits; the many rows of pairs hold numbers only.
    hashed = lake.rows.select(
        "table_id",
        "row_idx",
        F.transform(
            "cells",
            lambda c: F.when(
                c.isNotNull(), F.struct(F.xxhash64(c).alias("x"), F.xxhash64(F.lit(1), c).alias("y"))
            ),
        ).alias("cells"),
    )
    # Columns of each row whose text occurs in that row alone, spread by table and row.
    lone = (
        values.filter(F.col("n") - F.col("n_missing") == 1)
        .groupBy("table_id", F.col("first_present").alias("row_idx"))
        .agg(F.collect_list("col_idx").alias("lone"))
    )
    marked = hashed.join(lone, ["table_id", "row_idx"], "left")
    rows = attach(marked, wanted, ["table_id"], F.col("row_idx"), "n_rows", largest)
    one, two = F.col("one"), F.get("cells", F.col("col_2_idx"))
    cells = (
        rows.withColumn("one", F.get("cells", F.col("col_1_idx")))
        .filter(one.isNotNull() & ~F.coalesce(F.array_contains("lone", F.col("col_1_idx")), F.lit(False)))
        .select("table_id", "col_1_idx", "row_idx", "cells", "one", F.explode("others").alias("col_2_idx"))
        .select(
            *PAIR_KEY,
            "row_idx",
            one["x"].alias("a_x"),
            one["y"].alias("a_y"),
            # A missing dependent equals nothing: its row and no second hash.
            F.coalesce(two["x"], F.col("row_idx").cast("long")).alias("b_x"),
            two["y"].alias("b_y"),
        )
    )
    value_key = [*PAIR_KEY, "a_x", "a_y"]
    groups = cells.groupBy(*value_key, "b_x", "b_y").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first")
    )
    # Three groups per determinant value tell all: the second holds the violation, and dropping it
    # repairs the value if it is a single row and there is no third. Spark applies the limit before
    # the shuffle as well, so a hot determinant value sends three rows per task.
    order = Window.partitionBy(*value_key).orderBy("first")
    leading = groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= 3)
    violated = (
        leading.groupBy(*value_key)
        .agg(
            F.max("rank").alias("known"),
            F.max(F.when(F.col("rank") == 2, F.col("first"))).alias("row"),
            F.max(F.when(F.col("rank") == 2, F.col("n"))).alias("n"),
        )
        .filter(F.col("known") > 1)
    )
    repairs = (F.col("known") == 2) & (F.col("n") == 1)
    return violated.groupBy(*PAIR_KEY).agg(
        F.count(F.lit(1)).alias("violated"),
        F.min(F.col("row") * 2 + repairs.cast("long")).alias("code"),
    )


def dependency_measures(lake: Lake, features: DataFrame, values: DataFrame, largest: int) -> DataFrame:
    """One row per column pair: features of both, fd, fd_p and suspect_row.

    `largest` is the largest number of pair cells (rows times column pairs) of a table. Where every determinant value is violated
    both ratios are -1 and there is no suspect.
    """
    pairs = column_pairs(features)
    found = pairs.join(violations(lake, pairs, values, largest), PAIR_KEY, "left")
    good = F.col("n_distinct") - F.coalesce("violated", F.lit(0))
    none = F.col("good") == 0
    fd = F.col("good") / F.col("n_present")
    repaired = (F.col("good") + F.col("code") % 2) / (F.col("n_present") - 1)
    return found.withColumn("good", good).select(
        *PAIR_KEY,
        "d_type_1",
        "d_type_2",
        "rows_range",
        "avg_col_pre_1",
        "avg_col_pre_2",
        F.when(none, -1.0).otherwise(fd).alias("fd"),
        F.when(none, -1.0).when(F.col("code").isNull(), fd).otherwise(repaired).alias("fd_p"),
        F.when(~none, F.shiftright("code", 1)).alias("suspect_row"),
    )
