"""The lake: many tables as rows of canonical cell texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.text import base_type, cell_text, quoted
from tablewarden.operators import ordered
from tablewarden.operators.ordered import number_rows

CELL_BYTES = 32


@dataclass(frozen=True)
class Lake:
    """Tables of different shapes in one pair of DataFrames.

    rows     (table_id, row_idx, cells): one row per table row, cells as an array of texts in
             column order, NULL where a cell is missing.
    columns  (col_idx, col_name, base_type), with a leading table_id unless all tables are cut
             from the same schema.
    found_at  gives few rows from their keys, at most a row or so per column or pair of columns of a
             table, where making texts of those alone is less work.
    """

    rows: DataFrame
    columns: DataFrame
    found_at: Callable[[DataFrame, bool], DataFrame] | None = None

    def rows_at(self, keys: DataFrame, few: bool) -> DataFrame:
        """The rows of distinct (table_id, row_idx); `few` says that the keys may be broadcast."""
        if self.found_at is not None:
            return self.found_at(keys, few)
        return self.rows.join(F.broadcast(keys) if few else keys, ["table_id", "row_idx"], "left_semi")

    @property
    def uniform(self) -> bool:
        return "table_id" not in self.columns.columns

    def cells(self) -> DataFrame:
        """One row per cell: (table_id, col_idx, row_idx, value)."""
        return self.rows.select(
            "table_id", "row_idx", F.posexplode("cells").alias("col_idx", "value")
        )

    def with_columns(self, per_column: DataFrame, *fields: str) -> DataFrame:
        """Add column metadata to a DataFrame with one row per column of the lake."""
        wanted = self.columns.select(
            *(["col_idx"] if self.uniform else ["table_id", "col_idx"]), *fields
        )
        if self.uniform:  # as many rows as one table has columns
            return per_column.join(F.broadcast(wanted), "col_idx")
        return per_column.join(wanted, ["table_id", "col_idx"])


def column_frame(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    """(col_idx, col_name, base_type) of one schema."""
    entries = [
        F.struct(
            F.lit(i).alias("col_idx"), F.lit(name).alias("col_name"), F.lit(kind).alias("base_type")
        )
        for i, (name, kind) in enumerate(columns)
    ]
    return spark.range(1).select(F.inline(F.array(*entries)))


def typed_cells(df: DataFrame, names: list[str]) -> tuple[list[tuple[str, str]], Column]:
    fields = {f.name: f.dataType for f in df.schema.fields}
    kinds = [(n, base_type(fields[n])) for n in names]
    return kinds, F.array(*[cell_text(quoted(n), fields[n]) for n in names])


def _table_cells(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cells): cells of each table, a text counting as its bytes over CELL_BYTES and one.

    A plain window leaves a table in one task, so whether it may is a matter of bytes, not rows.
    """
    width = F.lit(len(df.columns))
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StringType):
            width += F.coalesce(F.floor(F.octet_length(field.name) / CELL_BYTES), F.lit(0))
    return df.groupBy(*keys).agg(F.sum(width).cast("long").alias("cells"))


def lake_from_table(
    df: DataFrame, table_key: str, order_by: list[str], columns: list[str]
) -> Lake:
    """Cut one DataFrame into a table per value of `table_key`, rows ordered by `order_by`."""
    kinds, cells = typed_cells(df, columns)
    key_type = df.schema[table_key].dataType
    # An order column that is a column of the table as well is shuffled once.
    orders = [c if c in columns else f"_order_{i}" for i, c in enumerate(order_by)]
    keyed = df.select(
        cell_text(F.col(table_key), key_type).alias("table_id"),
        *[F.col(c).alias(o) for c, o in zip(order_by, orders, strict=True) if c not in columns],
        *columns,
    )
    largest = _table_cells(keyed, ["table_id"]).agg(F.max("cells")).first()[0] or 0

    def numbered(source: DataFrame) -> DataFrame:
        return number_rows(source, ["table_id"], [F.col(o) for o in orders], largest=largest)

    def rows(found: DataFrame) -> DataFrame:
        # Texts are made after the shuffle: typed values are smaller, and few source files are no limit.
        return found.select("table_id", "row_idx", cells.alias("cells"))

    def found_at(keys: DataFrame, few: bool) -> DataFrame:
        # Tables are joined by the key that they are numbered by, so rows are shuffled once, as typed values.
        wanted = keys.groupBy("table_id").agg(F.collect_list("row_idx").alias("_wanted"))
        wanted = F.broadcast(wanted) if few else wanted
        found = numbered(keyed.join(wanted.drop("_wanted"), "table_id", "left_semi")).join(wanted, "table_id")
        return rows(found.filter(F.array_contains("_wanted", F.col("row_idx"))))

    # Rows of larger tables are written when they are numbered.
    again = found_at if largest <= ordered.GROUP_LIMIT else None
    return Lake(rows(numbered(keyed)), column_frame(df.sparkSession, kinds), again)


def lake_from_tables(
    tables: dict[str, tuple[DataFrame, list[str], list[str]]],
) -> Lake:
    """A lake of whole DataFrames: name -> (data, order columns, value columns)."""
    kept = {t: df.select(*dict.fromkeys([*order_by, *columns])) for t, (df, order_by, columns) in tables.items()}
    # One job for all tables.
    counted = [_table_cells(df, []).select(F.lit(t).alias("name"), "cells") for t, df in kept.items()]
    sizes = dict(reduce(DataFrame.union, counted).collect())
    lakes = []
    for name, (df, order_by, columns) in tables.items():
        kinds, cells = typed_cells(df, columns)
        numbered = number_rows(kept[name], [], [F.col(c) for c in order_by], largest=sizes[name] or 0)
        named = F.lit(name).alias("table_id")
        meta = column_frame(df.sparkSession, kinds).select(named, "*")
        # A table may have been numbered by one task; its texts are made by many.
        dealt = numbered.repartition("row_idx")
        lakes.append(Lake(dealt.select(named, "row_idx", cells.alias("cells")), meta))
    return union_lakes(*lakes)


def union_lakes(*lakes: Lake) -> Lake:
    """One lake of the tables of several; table ids must differ."""
    return Lake(
        reduce(DataFrame.unionByName, [lake.rows for lake in lakes]),
        reduce(DataFrame.unionByName, [lake.columns for lake in lakes]),
    )
