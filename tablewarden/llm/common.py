"""What the operators of this folder share: whole texts as bytes, and the split of labelled rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space between words; bytes.split() without an argument splits at just these.
SPACES = b" \t\n\x0b\x0c\r"
# A word as a Java and RE2 pattern.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text, null as empty."""
    return [t or b"" for t in texts.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch | pa.Array, texts: pa.Array, limit: int = 1 << 20):
    """Slices of `batch` whose `texts` have about `limit` bytes in all: what a task holds as Python
    objects at a time is bounded by that, or by one text."""
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64) + 16
    for a, b in pieces(sizes.tolist(), int, limit):
        yield batch.slice(a, b - a)


def pieces(items: list, weight, limit: int):
    """Consecutive slices of `items` of about `limit` weight in all, and one item at least."""
    start, total = 0, 0
    for i, item in enumerate(items):
        w = weight(item)
        if i > start and total + w > limit:
            yield start, i
            start, total = i, 0
        total += w
    if start < len(items):
        yield start, len(items)


def give_back() -> None:
    """Return what Arrow and the C library hold without use: workers live on while other stages run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidied(task: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over the batches of a task that gives memory back when it ends."""

    @wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sampled_labels(labels: DataFrame, limit: int) -> DataFrame:
    """At most `limit` labelled rows that may be learnt from, as (_label_id, _label).

    The rows with the smallest hashes of their id: the same whatever the partitioning. As the number
    is bounded, the sample may be broadcast. Rows without id or quality are left out.
    """
    fit = labels.where(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    )
    return (
        fit.select(F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_label_id"), "_label_id", "_label")
        .limit(limit)
    )


def spans(lengths: np.ndarray) -> np.ndarray:
    """Start of every run when runs of these lengths follow each other, and the end of the last."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
