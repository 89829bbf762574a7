"""Resampling documents towards a target by hashed n-gram importance, with segment deduplication.

Texts are cut into lines. The features of a distinct line, its runs of up to n words, are counted
once and multiplied by the line's occurrences; runs that go on over a line's end are added for each
text by themselves. With the target's counts this gives a gain for every bucket of features, and a
document's weight is the mean gain of its features. Noise that is a function of the document's id
makes the highest scores a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.llm.common import as_bytes, pieces, slices, spans
from tablewarden.session import ship_package, stage

# Features of at most so many bytes are hashed side by side, byte by byte.
SIDE_BY_SIDE = 48
# Bytes of text hashed at once, unless one text is longer. A byte costs about 40 bytes of memory.
HELD = 1 << 19


@lru_cache(maxsize=1)
def _crc_steps() -> np.ndarray:
    """The change of a CRC-32 by each byte, from its polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    return steps


def crc32_of(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every data[begin:end]."""
    steps, size = _crc_steps(), ends - begins
    clipped = np.minimum(size, SIDE_BY_SIDE + 1)
    order = np.argsort(-clipped, kind="stable")
    at, left, clipped = begins[order], size[order], clipped[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    # Longest first: of those hashed side by side, the ones with a byte at place k are a prefix.
    first = int(np.searchsorted(-clipped, -SIDE_BY_SIDE))
    counts = np.searchsorted(-left[first:], -np.arange(SIDE_BY_SIDE) - 0.5)
    for k, n in enumerate(counts.tolist()):
        if not n:
            break
        part = slice(first, first + n)
        now = crc[part]
        crc[part] = steps[(now ^ data[at[part] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
    crc[first:] ^= np.uint32(0xFFFFFFFF)
    for i in range(first):
        crc[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out


@lru_cache(maxsize=1)
def _word_bytes() -> np.ndarray:
    """For each byte the byte it counts as in a word, or 0: a-z, 0-9, A-Z lowered, and all of other letters."""
    kept = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        kept[low : high + 1] = np.arange(low, high + 1)
    kept[0x41:0x5B] = np.arange(0x61, 0x7B)
    return kept


class Runs:
    """The runs of 1 to `most` consecutive words of each text, hashed into buckets.

    Of each run: `owner` (text), `bucket`, and whether it `crosses` the end of a line. `words` counts
    the words of each text.
    """

    def __init__(self, texts: list[bytes], most: int, buckets: int):
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        starts = spans(np.array([len(t) + 1 for t in texts], np.int64))
        kept = _word_bytes()[data]
        on = kept > 0
        ends = np.flatnonzero(on[:-1] & ~on[1:]) + 1
        # Words with one blank after each; every other byte goes.
        stay = on.copy()
        stay[ends] = True
        flat = np.where(on, kept, 32).astype(np.uint8)[stay]
        place = np.cumsum(stay)
        begins = np.flatnonzero(on & ~np.concatenate([[False], on[:-1]]))
        word_owner = np.searchsorted(starts, begins, side="right") - 1
        line = np.cumsum(data == 10)[begins] if len(begins) else begins
        low, high = place[begins] - 1, place[ends] - 1
        owner, bucket, crosses = [], [], []
        n = len(begins)
        for size in range(1, most + 1):
            a = np.arange(max(0, n - size + 1))
            a = a[word_owner[a] == word_owner[a + size - 1]]
            b = a + size - 1
            owner.append(word_owner[a])
            bucket.append(crc32_of(flat, low[a], high[b]) % np.uint32(buckets))
            crosses.append(line[a] != line[b])
        self.owner, self.bucket, self.crosses = map(np.concatenate, (owner, bucket, crosses))
        self.words = np.bincount(word_owner, minlength=len(texts))


def _parts(batches: Iterator[pa.RecordBatch], column: int):
    """Slices of the batches with their texts as bytes, of a bounded number of bytes in all."""
    for batch in (part for b in batches for part in slices(b, b.column(column), HELD)):
        texts = as_bytes(batch.column(column))
        for low, high in pieces(texts, len, HELD):
            yield batch.slice(low, high - low), texts[low:high]


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of the column `text` fall into each bucket.

    Distinct lines are hashed once. A task answers with a row for each bucket at most.
    """
    ship_package(texts.sparkSession)

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for part, lines in _parts(batches, 0):
            runs, times = Runs(lines, most, buckets), part.column(1).to_numpy()
            np.add.at(counts, runs.bucket, times[runs.owner])
        yield _counted(counts)

    def over_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for _, whole in _parts(batches, 0):
            runs = Runs(whole, most, buckets)
            counts += np.bincount(runs.bucket[runs.crosses], minlength=buckets)
        yield _counted(counts)

    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").count()
    found = lines.mapInArrow(of_lines, "bucket long, n long")
    if most > 1:
        found = found.union(texts.select("text").mapInArrow(over_ends, "bucket long, n long"))
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln ((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket, from both counts.

    S and T are the totals of s and t. The result has `buckets` numbers, whatever the data.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, rows in ((s, source), (t, target)):
        for bucket, n in rows.collect():  # a row for each bucket at most
            counts[bucket] = n
    up, down = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((b + 1.0) * up / ((a + 1.0) * down))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256 of `seed:doc_id`; a null id is empty."""
    named = "" if doc_id is None else str(doc_id)
    h = int(hashlib.sha256(f"{seed}:{named}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, most: int, seed: int, carry: list[str]) -> DataFrame:
    """Of each document _row (a struct of the columns in `carry`), _doc_id, n_words, n_features, weight, score."""
    spark = docs.sparkSession
    ship_package(spark)
    known = spark.sparkContext.broadcast(gains)
    numbers = ["n_words", "n_features", "weight", "score"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _parts(batches, 0):
            runs = Runs(texts, most, len(known.value))
            n = np.bincount(runs.owner, minlength=len(texts))
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, runs.owner, known.value[runs.bucket])
            weight = total // np.maximum(n, 1)
            extra = np.array([noise(i, seed) for i in part.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(2), part.column(1), *[pa.array(x) for x in (runs.words, n, weight, weight + extra)]],
                ["_row", "_doc_id", *numbers],
            )

    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    rows = docs.select(F.col("text").alias("_text"), F.col("doc_id").alias("_doc_id"), row.alias("_row"))
    made = [rows.schema["_row"], rows.schema["_doc_id"], *[T.StructField(c, T.LongType()) for c in numbers]]
    return rows.mapInArrow(weigh, T.StructType(made))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 10,
    most: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 2024,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in `carry` (doc_id alone by default; "text" for the drawn texts themselves), and of
    every document n_features, weight, score and rank.

    Of the N documents with `least_words` words or more, the floor(percent * N / 100) of the highest
    scores are drawn: rank counts them from 1, ties by smaller doc_id and then fewer features, and is
    null for the others. Texts of `target` say what is wanted.

    Words are runs of a-z, 0-9 and all characters beyond ASCII, A-Z lowered. Null and empty texts have
    no features and weight 0. A null doc_id comes last among ties; repeated rows are documents of their
    own; an empty `docs` gives no rows and an empty `target` has no counts. Carried columns called like
    the new ones are replaced. Lines may be of any length; a task holds about 40 bytes for each byte of
    its longest text, or of HELD.
    """
    named = ("n_features", "weight", "score", "rank")
    carry = [c for c in (["doc_id"] if carry is None else carry) if c not in named]
    gains = bucket_gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets), buckets)
    rows = stage(weighed(docs, gains, most, seed, carry).withColumn("_id", F.monotonically_increasing_id()), "weighed")
    eligible = rows.where(F.col("n_words") >= least_words)
    # Scores are whole numbers in a range given by logarithms: some ten thousand, whatever the data.
    counts = eligible.groupBy("score").agg(F.count("*").alias("here"))
    higher = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = stage(counts.withColumn("above", F.coalesce(F.sum("here").over(higher), F.lit(0))), "scores")
    drawn = percent * (counts.agg(F.coalesce(F.sum("here"), F.lit(0))).first()[0]) // 100
    reached = counts.where(F.col("above") < drawn).select("score", "above")
    found = eligible.join(F.broadcast(reached), "score", "left")
    among = Window.partitionBy("score").orderBy(F.col("_doc_id").asc_nulls_last(), "n_features", "_id")
    ranked = (
        found.where(F.col("above").isNotNull())
        .withColumn("rank", F.col("above") + F.row_number().over(among))
        .withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    )
    fields = ["_row.*", "n_features", "weight", "score", "rank"]
    rest = rows.withColumn("rank", F.lit(None).cast("long"))
    low = found.where(F.col("above").isNull()).withColumn("rank", F.lit(None).cast("long"))
    few = rest.where(F.col("n_words") < least_words)
    return ranked.select(*fields).union(low.select(*fields)).union(few.select(*fields))
