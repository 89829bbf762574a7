"""Random split of the tables of a lake into a training and a test part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.operators.ordered import number_rows


def split_tables(tables: DataFrame, train_share: float, seed: int = 0) -> DataFrame:
    """(table_id, split): exactly int(share * n) of the n tables are `train`, the rest `test`.

    The order is that of a hash of seed and table, so the same tables always split alike, and a
    dirty and a clean lake can be split with the same result.
    """
    if not 0 <= train_share <= 1:
        raise ValueError("train_share must be between 0 and 1")
    ids = tables.select("table_id").distinct()
    n = ids.count()
    shuffled = ids.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("table_id"))))
    ranked = number_rows(
        shuffled, [], [F.col("_hash"), F.col("table_id")], "_rank", largest=n
    )
    train = F.col("_rank") < int(train_share * n)
    return ranked.select("table_id", F.when(train, "train").otherwise("test").alias("split"))


def part_of(df: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Rows of the tables in one part; `df` has a bounded number of rows per table."""
    return df.join(split.filter(F.col("split") == part).select("table_id"), "table_id", "left_semi")
