"""Largest robust deviation of numeric columns and of their logarithms, before and after dropping
the most deviating row.

The score of a cell is |v - median| / MAD. Both medians of both passes are order statistics: columns
of few values are ranked by windows, those of many are counted in histograms (`selection.py`), so a
column of any size is handled without gathering or sorting it. The middle three ranks serve the
median before and after the drop: the dropped row lies on one side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewarden.functions.scores import natural_log
from tablewarden.functions.text import number
from tablewarden.operators import ordered
from tablewarden.operators.joins import attach, fits_broadcast, json_bytes, with_group_totals
from tablewarden.operators.ordered import running_sums
from tablewarden.operators.profile import COLUMN_KEY
from tablewarden.operators.selection import at_ranks
from tablewarden.session import stage
from tablewarden.sources.lake import Lake

FORM_KEY = [*COLUMN_KEY, "log"]
# Distinct values of a column from which on its medians are found by histograms. Below, one task sorts them sooner.
HOT_VALUES = 2_000_000


def numeric_values(lake: Lake, values: DataFrame, together: bool = False) -> DataFrame:
    """(key, log, x, n, row) of the numbers of possibly numeric columns, raw and as logarithms.

    With `together` a column is shuffled to one task before the logarithms double its rows, where that
    is asked for anyway.
    """
    if lake.uniform:
        numeric = lake.columns.filter(
            F.col("base_type").isin("int64", "float64")
        ).select("col_idx")
        values = values.join(F.broadcast(numeric), "col_idx", "left_semi")
    x = number(F.col("text"))
    forms = F.array(
        F.struct(F.lit(False).alias("log"), F.col("x").alias("x")),
        F.struct(F.lit(True).alias("log"), natural_log(F.col("x")).alias("x")),
    )
    present = (F.col("n") - F.col("n_missing")).alias("n")
    numbers = values.filter(F.col("n") > F.col("n_missing")).select(
        *COLUMN_KEY, present, F.col("first_present").alias("row"), x.alias("x")
    ).filter(F.col("x").isNotNull())
    if together:
        numbers = numbers.repartition(*COLUMN_KEY)
    return numbers.select(*COLUMN_KEY, "n", "row", F.inline(forms)).filter(F.col("x").isNotNull())


def _at_rank(value: str, rank: Column) -> Column:
    """Aggregate: the value that covers a 0-based rank, given running counts in `upto`."""
    return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col(value)))


def _middle(low: Column, high: Column, odd: Column) -> Column:
    return F.when(odd, high).otherwise((low + high) / 2)


def _median_without(code: Column, low: Column, mid: Column, high: Column, odd: Column) -> Column:
    """The median without the row of `code`, which is odd if that row lies above the median."""
    return F.when(code % 2 == 1, F.when(odd, (low + mid) / 2).otherwise(low)).otherwise(
        F.when(odd, (mid + high) / 2).otherwise(mid)
    )


def _score_after(mad: Column, dev_max: Column) -> Column:
    return F.when(mad > 0, dev_max / mad).otherwise(F.lit(float("-inf")))


def scored_forms(numbers: DataFrame, largest: int) -> DataFrame:
    """(key, log, score, score_p, suspect_row) of every column form that has a score.

    `largest` is the largest number of distinct values of a column.
    """
    row = F.col("row")

    def totals(df: DataFrame, **aggregates: Column) -> DataFrame:
        return with_group_totals(df, FORM_KEY, aggregates, row, largest)

    def ranked(df: DataFrame, value: str) -> DataFrame:
        return running_sums(df, FORM_KEY, [F.col(value), row], {"upto": F.col("n")}, largest)

    odd = F.col("total") % 2 == 1
    half = F.floor(F.col("total") / 2)
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")

    df = ranked(totals(numbers, total=F.sum("n")), "x")
    df = totals(
        df,
        low=_at_rank("x", half - 1),
        mid=_at_rank("x", half),
        high=_at_rank("x", half + 1),
    )
    # If the median is infinite (half of the logarithms are of zeros) there is no score.
    df = (
        df.withColumn("median", _middle(low, mid, odd))
        .filter(F.col("median") > float("-inf"))
        .withColumn("dev", F.abs(F.col("x") - F.col("median")))
    )
    df = ranked(df.drop("upto"), "dev")
    df = totals(
        df,
        dev_low=_at_rank("dev", half - 1),
        dev_mid=_at_rank("dev", half),
        dev_max=F.max("dev"),
    )
    df = (
        df.withColumn("mad", _middle(F.col("dev_low"), F.col("dev_mid"), odd))
        .filter(F.col("mad") > 0)
        .withColumn("score", F.col("dev_max") / F.col("mad"))
    )
    # The first row with the largest score, and whether it lies above the median, in one number.
    above = (F.col("x") > F.col("median")).cast("long")
    df = totals(
        df,
        code=F.min(F.when(F.col("dev") / F.col("mad") == F.col("score"), row * 2 + above)),
    )
    suspect = F.shiftright("code", 1)
    median_p = _median_without(F.col("code"), low, mid, high, odd)
    df = (
        df.withColumn("n", F.col("n") - (row == suspect).cast("long"))
        .filter(F.col("n") > 0)
        .withColumn("median_p", median_p)
        .withColumn("total", F.col("total") - 1)
        .withColumn(
            "dev",
            # No deviation from an infinite median; all such rows rank alike.
            F.when(F.col("median_p") > float("-inf"), F.abs(F.col("x") - F.col("median_p"))),
        )
        .select(*FORM_KEY, "row", "n", "total", "dev", "score", suspect.alias("suspect_row"))
    )
    df = ranked(df, "dev")
    final = df.groupBy(*FORM_KEY).agg(
        F.max("score").alias("score"),
        F.max("suspect_row").alias("suspect_row"),
        F.max("total").alias("total"),
        _at_rank("dev", half - 1).alias("dev_low"),
        _at_rank("dev", half).alias("dev_mid"),
        F.max("dev").alias("dev_max"),
    )
    mad_p = _middle(F.col("dev_low"), F.col("dev_mid"), odd)
    return final.select(
        *FORM_KEY,
        "score",
        _score_after(mad_p, F.col("dev_max")).alias("score_p"),
        "suspect_row",
    )


def selected_forms(numbers: DataFrame, largest: int) -> DataFrame:
    """As `scored_forms`, for columns of many values: only bins of histograms and column summaries are shuffled."""
    row, x = F.col("row"), F.col("x")
    odd = F.col("total") % 2 == 1
    half = F.floor(F.col("total") / 2)
    low, mid, high = F.col("low"), F.col("mid"), F.col("high")
    around = {"dev_low": half - 1, "dev_mid": half}

    def lift(summary: DataFrame, *columns: str) -> DataFrame:
        summary = summary.select(*FORM_KEY, "extent", *columns)
        return attach(numbers, summary, FORM_KEY, row, "extent", largest, HOT_VALUES, small=small)

    def select(df: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
        return at_ranks(df, FORM_KEY, value, ranks, largest, HOT_VALUES)

    centres = stage(
        select(numbers, "x", {"low": half - 1, "mid": half, "high": half + 1})
        .drop("greatest")
        .withColumn("median", _middle(low, mid, odd))
        .filter(F.col("median") > float("-inf")),
        "centres",
    )
    small = fits_broadcast(*centres.agg(F.count(F.lit(1)), json_bytes(centres)).first())
    spread = select(lift(centres, "median").withColumn("dev", F.abs(x - F.col("median"))), "dev", around)
    scored = stage(
        centres.join(spread.drop("total", "extent"), FORM_KEY)
        .withColumn("mad", _middle(F.col("dev_low"), F.col("dev_mid"), odd))
        .filter(F.col("mad") > 0)
        .withColumn("score", F.col("greatest") / F.col("mad"))
        .drop("dev_low", "dev_mid", "greatest"),
        "scored",
    )
    codes = (
        lift(scored, "median", "mad", "score")
        .filter(F.abs(x - F.col("median")) / F.col("mad") == F.col("score"))
        .groupBy(*FORM_KEY)
        .agg(F.min(row * 2 + (x > F.col("median")).cast("long")).alias("code"))
    )
    without = stage(
        scored.join(codes, FORM_KEY).select(
            *FORM_KEY,
            "extent",
            "score",
            F.shiftright("code", 1).alias("suspect_row"),
            _median_without(F.col("code"), low, mid, high, odd).alias("median_p"),
        ),
        "without",
    )
    # No deviation from an infinite median.
    left = (
        lift(without, "suspect_row", "median_p")
        .withColumn("n", F.col("n") - (row == F.col("suspect_row")).cast("long"))
        .filter((F.col("n") > 0) & (F.col("median_p") > float("-inf")))
        .withColumn("dev", F.abs(x - F.col("median_p")))
    )
    after = without.join(select(left, "dev", around).drop("extent"), FORM_KEY, "left")
    mad_p = _middle(F.col("dev_low"), F.col("dev_mid"), odd)
    return after.select(
        *FORM_KEY, "score", _score_after(mad_p, F.col("greatest")).alias("score_p"), "suspect_row"
    )


def _all_forms(lake: Lake, values: DataFrame, profiled: DataFrame, largest: int) -> DataFrame:
    if largest <= HOT_VALUES:
        return scored_forms(numeric_values(lake, values, largest <= ordered.GROUP_LIMIT), largest)
    numbers = numeric_values(lake, values)
    hot = profiled.filter(F.col("n_distinct") > HOT_VALUES).select(*COLUMN_KEY, "n_rows", F.lit(True).alias("hot"))
    numbers = stage(
        attach(numbers, hot, COLUMN_KEY, F.col("row"), "n_rows", largest, HOT_VALUES, how="left"), "numbers"
    )
    few = scored_forms(numbers.filter(F.col("hot").isNull()).drop("hot"), HOT_VALUES)
    return few.union(selected_forms(numbers.filter("hot").drop("hot"), largest))


def outlier_measures(lake: Lake, values: DataFrame, profiled: DataFrame, largest: int) -> DataFrame:
    """One row per numeric column with a score: plain type, rows_range, raw and log scores.

    A log form without a score counts as infinite, before and after.
    """
    forms = _all_forms(lake, values, profiled, largest)
    raw, log = ~F.col("log"), F.col("log")
    infinite = F.lit(float("inf"))
    both = (
        forms.groupBy(*COLUMN_KEY)
        .agg(
            F.max(F.when(raw, F.col("score"))).alias("max_mad"),
            F.max(F.when(raw, F.col("score_p"))).alias("max_mad_p"),
            F.coalesce(F.max(F.when(log, F.col("score"))), infinite).alias("max_mad_log"),
            F.coalesce(F.max(F.when(log, F.col("score_p"))), infinite).alias("max_mad_log_p"),
            F.max(F.when(raw, F.col("suspect_row"))).alias("suspect_row"),
        )
        .filter(F.col("max_mad").isNotNull())
    )
    numeric = profiled.filter(F.col("base_type").isin("int64", "float64")).select(
        *COLUMN_KEY, F.col("base_type").alias("d_type"), "rows_range"
    )
    return numeric.join(both, COLUMN_KEY)
