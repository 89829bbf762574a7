"""The value dictionary: every distinct text of every column, with counts and first rows.

All column measures are functions of it, so the cells of a lake are shuffled once, spread by
(table, column, text) and already combined on the map side. A hot table or column is spread over
its texts; a hot text is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.text import MISSING_TEXT
from tablewarden.sources.lake import Lake


def value_dictionary(lake: Lake) -> DataFrame:
    """(table_id, col_idx, text, n, n_missing, first_row, first_present).

    Missing cells read as `nan`; n_missing tells how many of the n rows are missing, and
    first_present is the first row where the text is really there.
    """
    present = F.col("value").isNotNull()
    return (
        lake.cells()
        .withColumn("text", F.coalesce("value", F.lit(MISSING_TEXT)))
        .groupBy("table_id", "col_idx", "text")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(~present).alias("n_missing"),
            F.min("row_idx").alias("first_row"),
            F.min(F.when(present, F.col("row_idx"))).alias("first_present"),
        )
    )
