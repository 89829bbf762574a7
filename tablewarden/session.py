"""Session set-up and the folder for stage tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", app: str = "tablewarden") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application; they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        made = tempfile.mkdtemp(prefix="tablewarden-package-")
        spark.sparkContext.addPyFile(
            shutil.make_archive(
                f"{made}/tablewarden", "zip", os.path.dirname(package), os.path.basename(package)
            )
        )
        _shipped.add(app)


def stage_dir(spark: SparkSession) -> str:
    """The shared folder for stage tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tablewarden-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_owners: list[list[str]] = []


@contextmanager
def owned_stages(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, the stage tables written inside it.

    Results that are not written or collected by then can no longer be read. Blocks may be nested;
    outside any block stage tables are left to the folder's retention rules.
    """
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write `df` as a stage table and read it back.

    Cuts the lineage, so a lost executor costs a re-read rather than a recomputation, and gives
    every later job the same rows. `codec` compresses it otherwise than the session's tables are.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _owners:
        _owners[-1].append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
