"""Order statistics of weighted numbers by counting them in histograms; no group is sorted or gathered.

A first histogram has bins of equal width in the logarithm, at most some 46,000 of them for a group
whatever its numbers are, so counting is combined on the map side. Only rows of the bins that hold a
wanted rank go on, to bins of equal width between the smallest and largest number of theirs. Bins of
both kinds never cut between equal numbers, and the outer two of a later histogram differ, so it ends:
once the largest interval is small, every number is a bin of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.operators.joins import attach, fits_broadcast, json_bytes
from tablewarden.session import stage

# Bins of a later histogram, and rows of an interval whose numbers are bins themselves.
BINS = 4096
SINGLE = 50_000


def _log_bin(x: Column) -> Column:
    """A whole number that grows with x; zero, the infinities and NaN have one each."""
    size = F.floor(F.least(F.ln(F.abs(x)), F.lit(800.0)) * 16) + 20_000
    return F.when(x == 0, F.lit(0).cast("long")).when(F.isnan(x), 40_000).when(x > 0, size).otherwise(-size)


def _even_bin(x: Column, bins: int) -> Column:
    share = F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    return F.least(share, F.lit(bins - 1).cast("long"))


def _histogram(rows: DataFrame, keys: list[str], bin_of: Column, x: Column) -> DataFrame:
    """Weight, smallest and largest number and rows of every bin, and the weight up to and with it."""
    bins = rows.groupBy(*keys, bin_of.alias("_bin")).agg(
        F.sum("n").alias("n"),
        F.min(x).alias("_lo"),
        F.max(x).alias("_hi"),
        F.count(F.lit(1)).alias("_size"),
        F.max("row").alias("_last"),
    )
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    return bins.withColumn("_upto", F.sum("n").over(upto)).withColumn("_before", F.col("_upto") - F.col("n"))


def at_ranks(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Column],
    largest: int,
    limit: int | None = None,
    bins: int | None = None,
    single: int | None = None,
) -> DataFrame:
    """One row per group: keys, total weight, extent (largest row + 1), greatest, and the number at every rank.

    `df` has the keys, `value` (double, never null), n (weight, at least 1) and row (a number of the
    row within its group). `ranks` are 0-based expressions of `total`; NULL stands for a rank that a
    group does not have. `largest` and `limit` are those of `attach`.
    """
    bins = BINS if bins is None else bins
    single = SINGLE if single is None else single
    x = F.col(value)
    counted = _histogram(df, keys, _log_bin(x), x).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))

    def covering(rank: Column) -> Column:
        inside = (F.col("_upto") > rank) & (F.col("_before") <= rank)
        hit = F.struct(
            (rank - F.col("_before")).alias("rank"),
            F.col("_lo").alias("lo"),
            F.col("_hi").alias("hi"),
            F.col("_size").alias("size"),
        )
        return F.max(F.when(inside, hit))

    summary = stage(
        counted.groupBy(*keys).agg(
            F.max("total").alias("total"),
            (F.max("_last") + 1).alias("extent"),
            F.max("_hi").alias("greatest"),
            *[covering(rank).alias(f"_{name}") for name, rank in ranks.items()],
        ),
        "ranks",
    )
    named = [F.struct(F.lit(name).alias("name"), F.col(f"_{name}.*")) for name in ranks]
    found = summary.select(*keys, "extent", F.inline(F.array(*named))).filter(F.col("lo").isNotNull())
    rows, settled = df.select(*keys, "row", "n", value), None
    while True:
        done = found.filter(F.col("lo") == F.col("hi")).select(*keys, "name", "lo")
        settled = done if settled is None else settled.union(done)
        found = found.filter(F.col("lo") != F.col("hi"))
        size, intervals, held = found.agg(F.max("size"), F.count(F.lit(1)), json_bytes(found)).first()
        if size is None:
            break
        parts = found.select(*keys, "extent", "lo", "hi").distinct()
        small = fits_broadcast(intervals, held)
        inside = attach(rows, parts, keys, F.col("row"), "extent", largest, limit, small=small)
        inside = inside.filter(x.between(F.col("lo"), F.col("hi")))
        inside = stage(inside.select(*keys, "row", "n", value, "lo", "hi"), "intervals")
        bin_of = x if size <= single else _even_bin(x, bins)
        narrowed = _histogram(inside, [*keys, "lo"], bin_of, x)
        found = stage(
            narrowed.join(found.select(*keys, "extent", "name", "rank", "lo"), [*keys, "lo"])
            .filter((F.col("_upto") > F.col("rank")) & (F.col("_before") <= F.col("rank")))
            .select(
                *keys,
                "extent",
                "name",
                (F.col("rank") - F.col("_before")).alias("rank"),
                F.col("_lo").alias("lo"),
                F.col("_hi").alias("hi"),
                F.col("_size").alias("size"),
            ),
            "ranks",
        )
        rows = inside.drop("lo", "hi")
    values = settled.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks])
    return summary.select(*keys, "total", "extent", "greatest").join(values, keys, "left")
