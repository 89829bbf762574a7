"""Learning: measures of a training lake, compressed to counts per features and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UV_FEATURES = ["d_type", "rows_range", "left_ness", "avg_col_pre"]
FD_FEATURES = [
    "d_type_1",
    "d_type_2",
    "rows_range",
    "left_ness_1",
    "left_ness_2",
    "avg_col_pre_1",
    "avg_col_pre_2",
]
NO_FEATURES = ["d_type", "rows_range"]
SE_FEATURES = ["d_type", "rows_range", "range_mpd"]

UV_SCORES = ("ur", "ur_p")
FD_SCORES = ("fd", "fd_p")
NO_SCORES = ("max_mad", "max_mad_p")
NO_LOG_SCORES = ("max_mad_log", "max_mad_log_p")
SE_SCORES = ("mpd", "mpd_p")


def _compress(measures: DataFrame, columns: list[str]) -> DataFrame:
    return measures.groupBy(*columns).agg(F.count(F.lit(1)).alias("w"))


def uv_model(measures: DataFrame) -> DataFrame:
    return _compress(measures.filter(F.col("ur").isNotNull()), [*UV_FEATURES, *UV_SCORES])


def fd_model(measures: DataFrame) -> DataFrame:
    """Pairs whose ratio does not change are never counted."""
    return _compress(measures.filter(F.col("fd") != F.col("fd_p")), [*FD_FEATURES, *FD_SCORES])


def no_model(measures: DataFrame) -> DataFrame:
    return _compress(measures, [*NO_FEATURES, *NO_SCORES, *NO_LOG_SCORES])


def se_model(measures: DataFrame) -> DataFrame:
    return _compress(measures, [*SE_FEATURES, *SE_SCORES])
