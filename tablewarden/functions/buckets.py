"""Range buckets used as column features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive upper ends of the buckets 0, 1, 2, ...; larger numbers get the next bucket.
ROW_COUNT_BOUNDS = (20, 50, 100, 500, 1000)
TOKEN_LENGTH_BOUNDS = (5, 10, 15, 20)
PREVALENCE_BOUNDS = (50, 100, 1_000, 10_000, 100_000)


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """Index of the first bound that is not below `value`; NULL for NULL."""
    result = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, bound in enumerate(bounds):
        result = result.when(value <= bound, i)
    return result.otherwise(len(bounds))


def rows_range(count: Column) -> Column:
    return bucket(count, ROW_COUNT_BOUNDS)


def token_length_range(length: Column) -> Column:
    return bucket(length, TOKEN_LENGTH_BOUNDS)


def prevalence_range(prevalence: Column) -> Column:
    return bucket(prevalence, PREVALENCE_BOUNDS)
