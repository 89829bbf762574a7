"""What is measured of a lake: value dictionary, profile, prevalence and the four scores.

`Measured` computes every part once and writes it as a stage table, in the order the parts need
each other; parts nobody asks for are not computed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tablewarden.operators.dependency import dependency_measures
from tablewarden.operators.joins import attach
from tablewarden.operators.outlier import outlier_measures
from tablewarden.operators.profile import COLUMN_KEY, profile, table_catalog
from tablewarden.operators.spelling import spelling_measures
from tablewarden.operators.tokens import column_prevalence, lake_tokens, table_tokens
from tablewarden.operators.values import value_dictionary
from tablewarden.session import stage
from tablewarden.sources.lake import Lake


@dataclass
class Measured:
    """Measures of one lake.

    tokens           token counts to look prevalences up in; the lake's own by default
    n_cells_limit    tables with at least this many cells are left out of the outlier and spelling
                     measures (None: no limit)
    token_cells_limit  tables with at least this many cells are left out of the token counts (None: no limit)
    prevalence_mode  "sum" or "mean" over the rows of a column
    """

    lake: Lake
    tokens: DataFrame | None = None
    n_cells_limit: int | None = None
    token_cells_limit: int | None = None
    prevalence_mode: str = "sum"
    double_bucket: bool = False

    @cached_property
    def values(self) -> DataFrame:
        return stage(value_dictionary(self.lake), "values")

    @cached_property
    def profile(self) -> DataFrame:
        return stage(profile(self.lake, self.values), "profile")

    @cached_property
    def catalog(self) -> DataFrame:
        return table_catalog(self.profile)

    @cached_property
    def table_tokens(self) -> DataFrame:
        return table_tokens(self.within(self.token_cells_limit))

    @cached_property
    def features(self) -> DataFrame:
        """The profile with avg_col_pre."""
        counts = self.tokens
        if counts is None:
            counts = lake_tokens(self.within(self.token_cells_limit))
        prevalence = column_prevalence(self.values, counts, self.prevalence_mode)
        return stage(
            self.profile.join(prevalence.select(*COLUMN_KEY, "avg_col_pre"), COLUMN_KEY), "features"
        )

    @cached_property
    def sizes(self) -> Row:
        """Largest n_rows, n_distinct and n_texts of a column, and n_cells and n_pairs (cells of all
        its column pairs) of a table, in one pass."""
        tables = self.profile.groupBy("table_id").agg(
            F.max("n_rows").alias("n_rows"),
            F.max("n_distinct").alias("n_distinct"),
            F.max("n_texts").alias("n_texts"),
            (F.max("n_rows") * F.count(F.lit(1))).alias("n_cells"),
            F.floor(F.max("n_rows") * F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).alias("n_pairs"),
        )
        sizes = ("n_rows", "n_distinct", "n_texts", "n_cells", "n_pairs")
        return tables.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in sizes]).first()

    def within(self, n_cells_limit: int | None) -> DataFrame:
        """Values of the tables below a cell budget."""
        if n_cells_limit is None or self.sizes.n_cells < n_cells_limit:
            return self.values
        over = self.catalog.filter(F.col("n_cells") >= n_cells_limit)
        return attach(
            self.values,
            over.select("table_id", "n_rows"),
            ["table_id"],
            F.col("first_row"),
            "n_rows",
            self.sizes.n_cells,
            how="left_anti",
        )

    def uv(self) -> DataFrame:
        """Uniqueness of every column: features, ur, ur_p and suspect_row."""
        return self.features.select(
            *COLUMN_KEY,
            "d_type",
            "rows_range",
            F.col("col_idx").alias("left_ness"),
            "avg_col_pre",
            "ur",
            "ur_p",
            F.col("dup_row").alias("suspect_row"),
        )

    def fd(self) -> DataFrame:
        """Compliance of every column pair: features, fd, fd_p and suspect_row."""
        measures = dependency_measures(self.lake, self.features, self.values, self.sizes.n_pairs)
        return measures.withColumns(
            {"left_ness_1": F.col("col_1_idx"), "left_ness_2": F.col("col_2_idx")}
        )

    def no(self) -> DataFrame:
        """Outlier scores of every numeric column that has one."""
        values = self.within(self.n_cells_limit)
        return outlier_measures(self.lake, values, self.profile, self.sizes.n_distinct)

    def se(self) -> DataFrame:
        """Smallest edit distances of every column that has one."""
        return spelling_measures(
            self.within(self.n_cells_limit),
            self.profile,
            self.sizes.n_texts,
            self.double_bucket,
        )

