"""Written results: models, per-table outputs, findings and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS_PER_FILE = 10_000_000


def write_model(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_table(
    df: DataFrame, path: str, buckets: int = 256, table: str = "table_id", files: int = 4
) -> None:
    """Per-table outputs (measures, findings), tables grouped into a fixed number of folders.

    One folder per table would be millions of files; a reader of one table filters on its bucket.
    Rows of a bucket are dealt to at most `files` files, hot tables among them.
    """
    bucket = table_bucket(F.col(table), buckets)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    dealt = df.withColumn("bucket", bucket).repartition(F.col("bucket"), salt)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(path)


def table_bucket(table: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(table), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, path: str, table: str, buckets: int = 256, key: str = "table_id") -> DataFrame:
    """The output of one table; only its bucket is read."""
    found = spark.read.parquet(path)
    wanted = (F.col("bucket") == table_bucket(F.lit(table), buckets)) & (F.col(key) == table)
    return found.filter(wanted).drop("bucket")


def write_findings(findings: DataFrame, path: str, file_type: str = "csv") -> None:
    writer = findings.write.mode("overwrite")
    if file_type == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(file_type).save(path)


def write_tokens(tokens: DataFrame, path: str, per_file: int = TOKENS_PER_FILE) -> None:
    """Token counts, of a lake or per table, in files of bounded length."""
    tokens.write.mode("overwrite").option("maxRecordsPerFile", per_file).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
