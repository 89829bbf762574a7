"""Results that grow from run to run: training measures with the models they give, findings, token counts.

Each store is a folder. What a run adds is a batch of its own, and a batch counts once the ledger
names it, which is written last: a run that is lost half-way leaves nothing that is read, and can be
repeated.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.sources.sinks import table_bucket

BUCKETS = 64


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet folder at `path`, None if there is none yet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# ---- training ------------------------------------------------------------------------------------

# ledger    (batch, kind, table_id): the tables that a finished batch has learnt from, for one detector
# measures  the rows of these tables, in folders by batch and by a hash of the table
# models    the counts of each batch, as plans.learn compresses them


def _ledger(spark: SparkSession, path: str, kind: str) -> DataFrame:
    found = _read(spark, f"{path}/ledger/{kind}", "batch string, table_id string")
    return spark.createDataFrame([], "batch string, table_id string") if found is None else found


def learnt_tables(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(table_id) of all tables that the store has learnt from."""
    return _ledger(spark, path, kind).select("table_id").distinct()


def learn_tables(measures: DataFrame, path: str, kind: str, learn, buckets: int = BUCKETS) -> None:
    """Learn from the tables of `measures` (of one detector) that the store does not have yet.

    `learn` is the detector's function of plans.learn. Tables known already are left alone, whatever
    is measured of them now. Nothing is written if there is no new table.
    """
    spark = measures.sparkSession
    new = measures.join(learnt_tables(spark, path, kind), "table_id", "left_anti")
    if new.isEmpty():
        return
    batch = f"b{uuid.uuid4().hex}"
    bucket = table_bucket(F.col("table_id"), buckets)
    kept = f"{path}/measures/{kind}/batch={batch}"
    new.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(kept)
    # What follows reads what was written, so that counts and ledger are those of the stored rows.
    rows = spark.read.parquet(kept)
    learn(rows.drop("bucket")).write.parquet(f"{path}/models/{kind}/batch={batch}")
    tables = rows.select(F.lit(batch).alias("batch"), "table_id").distinct()
    tables.write.mode("append").parquet(f"{path}/ledger/{kind}")


def _finished(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Rows of the batches that the ledger names: as many names as there were runs."""
    batches = _ledger(df.sparkSession, path, kind).select("batch").distinct()
    return df.join(F.broadcast(batches), "batch", "left_semi").drop("batch")


def stored_model(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The model of all tables learnt so far: equal features and scores of the batches add their weights."""
    counts = _finished(spark.read.parquet(f"{path}/models/{kind}"), path, kind)
    return counts.groupBy(*[c for c in counts.columns if c != "w"]).agg(F.sum("w").alias("w"))


def stored_measures(spark: SparkSession, path: str, kind: str, table: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The measures of all tables learnt so far, or of one, of which only its folders are read."""
    rows = spark.read.parquet(f"{path}/measures/{kind}")
    if table is not None:
        rows = rows.filter((F.col("bucket") == table_bucket(F.lit(table), buckets)) & (F.col("table_id") == table))
    return _finished(rows, path, kind).drop("bucket")


# ---- findings ------------------------------------------------------------------------------------


def write_findings_by_table(
    findings: DataFrame, tables: DataFrame, path: str, rejected: DataFrame | None = None, buckets: int = BUCKETS
) -> None:
    """Findings in folders by a hash of their table, and a record of every table that was searched.

    `tables` has the table_id of all of them: tables without findings are recorded with none, and
    files that could not be read, `rejected` with (path, error), with their reason.
    """
    spark = findings.sparkSession
    bucket = table_bucket(F.col("path"), buckets)
    # A table may have most findings: its bucket is dealt to a few tasks.
    salt = F.pmod(F.xxhash64("row_idx"), F.lit(4))
    dealt = findings.withColumn("bucket", bucket).repartition(F.col("bucket"), salt)
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/findings")
    counts = spark.read.schema(dealt.schema).parquet(f"{path}/findings").groupBy("path").agg(F.count("*").alias("n_findings"))
    record = (
        tables.select(F.col("table_id").alias("path"))
        .distinct()
        .join(counts, "path", "left")
        .select("path", F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"), F.lit(None).cast("string").alias("error"))
    )
    if rejected is not None:
        record = record.union(rejected.select("path", F.lit(0).cast("long"), "error"))
    record.write.mode("overwrite").parquet(f"{path}/tables")


def searched_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_findings, error) of every table that was searched or rejected."""
    return spark.read.parquet(f"{path}/tables")


def findings_of_table(spark: SparkSession, path: str, table: str, buckets: int = BUCKETS) -> DataFrame:
    """The findings of one table; only its folder is read."""
    found = spark.read.parquet(f"{path}/findings")
    wanted = (F.col("bucket") == table_bucket(F.lit(table), buckets)) & (F.col("path") == table)
    return found.filter(wanted).drop("bucket")


# ---- token counts --------------------------------------------------------------------------------


def _declared(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The runs at `path`, read as a table whose buckets Spark knows."""
    name = f"token_runs_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (token STRING, cnt BIGINT) USING parquet "
        f"CLUSTERED BY (token) SORTED BY (token) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the declaration only
    return found


def write_token_runs(tokens: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """(token, cnt) as sorted runs: a file for each of `buckets` hash ranges, sorted by token."""
    name = f"token_runs_{uuid.uuid4().hex}"
    dealt = tokens.select("token", F.col("cnt").cast("long").alias("cnt")).repartition(buckets, "token")
    writer = dealt.write.format("parquet").bucketBy(buckets, "token").sortBy("token")
    writer.option("path", path).saveAsTable(name)
    tokens.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def read_token_runs(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """(token, cnt) of written runs. Joins and aggregates by token take them as they lie."""
    return _declared(spark, path, buckets)


def merge_token_runs(spark: SparkSession, path: str, new: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(token, cnt): counts of the runs at `path` and of `new`, added up.

    Only the new counts are shuffled, into the buckets of the runs, which are read where they lie.
    """
    known = _declared(spark, path, buckets).withColumnRenamed("cnt", "known")
    added = new.groupBy("token").agg(F.sum("cnt").alias("added")).repartition(buckets, "token")
    both = known.hint("merge").join(added, "token", "full")
    total = F.coalesce("known", F.lit(0)) + F.coalesce("added", F.lit(0))
    return both.select("token", total.cast("long").alias("cnt"))
