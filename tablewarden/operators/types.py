"""Types of columns that are read as text, from one small number per cell.

A cell says with a bit each which types its text could be of; a column is of the types that all its
cells have in common. The bits of a column are combined on the map side, so what is shuffled is a row
per column and task, never a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import BOOLEAN_PATTERN, INTEGER_PATTERN, NUMBER_PATTERN

INTEGER, NUMBER, BOOLEAN = 1, 2, 4


def type_bits(cell: Column) -> Column:
    """The types that a text could be of; a missing cell could be of any."""
    return (
        F.when(cell.isNull(), INTEGER | NUMBER | BOOLEAN)
        .when(cell.rlike(INTEGER_PATTERN), INTEGER | NUMBER)
        .when(cell.rlike(NUMBER_PATTERN), NUMBER)
        .when(cell.rlike(BOOLEAN_PATTERN), BOOLEAN)
        .otherwise(0)
    )


def column_types(rows: DataFrame) -> DataFrame:
    """(table_id, col_idx, base_type, n_rows) of the columns of rows of texts.

    Whole numbers and truth values with a missing cell among them are float64 and object; a column
    without any text is float64.
    """
    found = (
        rows.select("table_id", F.posexplode("cells").alias("col_idx", "value"))
        .groupBy("table_id", "col_idx")
        .agg(
            F.bit_and(type_bits(F.col("value"))).alias("bits"),
            F.count("value").alias("n_present"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
    whole = F.col("n_present") == F.col("n_rows")

    def all_are(kind: int) -> Column:
        return F.col("bits").bitwiseAND(kind) != 0

    kind = (
        F.when(F.col("n_present") == 0, "float64")
        .when(all_are(INTEGER) & whole, "int64")
        .when(all_are(NUMBER), "float64")
        .when(all_are(BOOLEAN) & whole, "bool")
        .otherwise("object")
    )
    return found.select("table_id", "col_idx", kind.alias("base_type"), "n_rows")
