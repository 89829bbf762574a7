"""Arithmetic of scores, ratios and error flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_log(x: Column) -> Column:
    """ln with -Infinity at zero; NULL below zero."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf")))


def likelihood_ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the ratio is undefined."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def better_ratio(raw: Column, log: Column) -> Column:
    """The larger of two ratios; an undefined one is skipped."""
    return F.greatest(raw, log)


def differs(dirty: Column, clean: Column) -> Column:
    """Text inequality of a dirty and a clean cell, missing reading as `nan`."""
    return F.coalesce(dirty, F.lit("nan")) != F.coalesce(clean, F.lit("nan"))


def label_error(label: Column) -> Column:
    """Labels 2 and 1 mean error and no error; anything else is unknown (-1)."""
    return F.when(label == 2, 1).when(label == 1, 0).otherwise(-1)
