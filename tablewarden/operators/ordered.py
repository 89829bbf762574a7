"""Running sums and row numbers that do not depend on group size.

A window sorts one group inside one task. That is right for the millions of small groups of a lake,
and wrong for a group that holds a large part of the data. `running_sums` therefore takes the size
of the largest group: up to GROUP_LIMIT rows it is a plain window; beyond, rows are range-partitioned
on (keys, order), summed inside each partition, and lifted by the sums of the earlier partitions.
Both ways give the same rows, provided that (keys, order) identifies a row or ties do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import stage

GROUP_LIMIT = 2_000_000


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group; one aggregate over the key columns only."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def running_sums(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    sums: dict[str, Column],
    largest: int,
    limit: int | None = None,
) -> DataFrame:
    """Add for every `sums` entry its sum over the rows up to and including this one."""
    limit = GROUP_LIMIT if limit is None else limit
    if largest <= limit:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(upto).alias(name) for name, c in sums.items()])

    # The partition number is read in two places below, so it has to be written down once.
    parts = stage(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(
            "_part", F.spark_partition_id()
        ),
        "ordered",
    )
    part_keys = [*keys, "_part"]
    upto = Window.partitionBy(*part_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(c).over(upto).alias(f"_in_{s}") for s, c in sums.items()])
    # At most one row per key and partition, so this window is small for every key.
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    # Written down as well: left as a window it would be partitioned by the keys alone, and the join
    # could follow that and gather a hot key again.
    offsets = stage(
        parts.groupBy(*part_keys)
        .agg(*[F.sum(c).alias(f"_all_{s}") for s, c in sums.items()])
        .select(
            *part_keys,
            *[F.coalesce(F.sum(f"_all_{s}").over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
        ),
        "offsets",
    )
    return local.join(offsets, part_keys).select(
        *df.columns, *[(F.col(f"_in_{s}") + F.col(f"_before_{s}")).alias(s) for s in sums]
    )


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    name: str = "row_idx",
    largest: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Dense 0-based row numbers inside each group."""
    if largest is None:
        largest = largest_group(df, keys)
    numbered = running_sums(df, keys, order, {name: F.lit(1).cast("long")}, largest, limit)
    return numbered.withColumn(name, F.col(name) - 1)
