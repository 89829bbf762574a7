"""Joins of the cell-sized side with a summary that has one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.operators.ordered import GROUP_LIMIT
from tablewarden.session import stage

# A summary is broadcast only when it was counted and has at most this many rows, and bytes as JSON.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
# Rows of one key that share a join task otherwise.
BLOCK_ROWS = 1_000_000


def _is_small(summary: DataFrame, rows: int) -> bool:
    if summary.count() > rows:
        return False
    size = summary.agg(json_bytes(summary)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def json_bytes(summary: DataFrame) -> Column:
    """Aggregate: bytes of all rows as JSON."""
    return F.sum(F.octet_length(F.to_json(F.struct(*summary.columns))))


def fits_broadcast(rows: int, size: int | None) -> bool:
    """Whether a summary of so many rows and bytes as JSON may be broadcast."""
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def attach(
    big: DataFrame,
    summary: DataFrame,
    keys: list[str],
    position: Column,
    extent: str,
    largest: int,
    limit: int | None = None,
    broadcast_rows: int | None = None,
    block_rows: int | None = None,
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Join (inner, left, left_semi or left_anti) that keeps a hot key of `big` spread over many tasks.

    `largest` is the size of the largest group of `big`; while that is small, this is a plain join.
    Beyond, a summary counted to be small is broadcast, and a larger one is joined on
    (keys, position // block), each of its rows repeated once per block of its key: once for an
    ordinary key, many times for a hot one. `position` is a number of a row of `big` within its key,
    below the key's `extent` in the summary. The block in the join key also keeps Spark from reusing
    the join's partitioning for a later groupBy on more columns, which would put the hot key back
    into one task. `small` says whether the summary was already found to be small, or not to be.
    """
    limit = GROUP_LIMIT if limit is None else limit
    broadcast_rows = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    block_rows = BLOCK_ROWS if block_rows is None else block_rows
    if largest <= limit:
        return big.join(summary.drop(extent), keys, how)
    if small is None:
        summary = stage(summary, "summary")
        small = _is_small(summary, broadcast_rows)
    if small:
        return big.join(F.broadcast(summary.drop(extent)), keys, how)
    last = F.floor((F.greatest(F.col(extent), F.lit(1)) - 1) / block_rows)
    blocks = summary.withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("long"), last))
    ).drop(extent)
    placed = big.withColumn("_block", F.floor(position / block_rows))
    return placed.join(blocks, [*keys, "_block"], how).drop("_block")


def with_group_totals(
    df: DataFrame,
    keys: list[str],
    totals: dict[str, Column],
    position: Column,
    largest: int,
    limit: int | None = None,
) -> DataFrame:
    """Add aggregates of its group to every row: by a window, or by `attach` where groups are large."""
    limit = GROUP_LIMIT if limit is None else limit
    if largest <= limit:
        group = Window.partitionBy(*keys)
        return df.select("*", *[c.over(group).alias(name) for name, c in totals.items()])
    summary = df.groupBy(*keys).agg(
        *[c.alias(name) for name, c in totals.items()], (F.max(position) + 1).alias("_extent")
    )
    return attach(df, summary, keys, position, "_extent", largest, limit)
