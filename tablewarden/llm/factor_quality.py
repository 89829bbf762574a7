"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

A document is a sparse vector: its distinct words hashed to buckets, each structure statistic as one
of a row of bins, and the size that the table states. The score adds a weight per feature and, for
every pair of features, the product of their factors; by the sum-of-squares identity the pairs cost
as much as the features: half the square of the sum less the sum of the squares, factor by factor.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tablewarden.llm.common import as_bytes, held_out, sampled_labels, slices, spans
from tablewarden.llm.quality_trees import FEATURES, statistics
from tablewarden.session import ship_package

WORD_BUCKETS = 1 << 14
# Bin edges of each structure statistic; shares are cut finely near zero.
_SHARE = [0.0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95]
EDGES = {
    name: np.array(
        list(np.arange(0.5, 14, 0.5)) if name == "log_words"
        else [1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24] if name == "word_length"
        else [1, 3, 6, 10, 15, 20, 30, 40, 60, 80, 120, 200, 400, 1000] if name == "words_per_line"
        else _SHARE
    )
    for name in FEATURES
}
SIZE_BINS = 32
_STARTS = spans(np.array([len(e) + 1 for e in EDGES.values()])) + WORD_BUCKETS
N_FEATURES = int(_STARTS[-1]) + SIZE_BINS


def features(text: bytes, size: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one document's features; words share a total square of one."""
    words = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in set(text.split())), np.int64)
    words = np.unique(words)
    _, stats = statistics(text)
    bins = [int(s) + int(np.searchsorted(e, x)) for s, e, x in zip(_STARTS, EDGES.values(), stats)]
    told = 0 if size is None else min(SIZE_BINS - 1, 1 + max(0, int(size)).bit_length())
    index = np.concatenate([words, bins, [int(_STARTS[-1]) + told]])
    value = np.ones(len(index))
    value[: len(words)] = 1 / np.sqrt(max(1, len(words)))
    return index, value


@dataclass
class FactorMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function, and the factor sums, of rows laid end to end.

        Every row has features (the bins), so no run is empty.
        """
        at = starts[:-1]
        vx = self.factor[index] * value[:, None]
        sums = np.add.reduceat(vx, at, axis=0)
        pairs = (sums**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1) / 2
        return self.bias + np.add.reduceat(self.weight[index] * value, at) + pairs, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = spans(np.array([len(i) for i, _ in rows]))
        raw, _ = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit_machine(
    rows: list[tuple[np.ndarray, np.ndarray]],
    y: np.ndarray,
    factors: int = 8,
    epochs: int = 6,
    batch: int = 256,
    rate: float = 0.1,
    decay: float = 1e-5,
    seed: int = 11,
) -> FactorMachine:
    """Logistic loss by mini-batches with per-weight step sizes (AdaGrad); always the same result.

    With no rows the score is one half for all.
    """
    draw = np.random.default_rng(seed)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    m = FactorMachine(float(np.log(share / (1 - share))), np.zeros(N_FEATURES), draw.normal(0, 0.02, (N_FEATURES, factors)))
    seen_w, seen_v = np.full(N_FEATURES, 1e-6), np.full((N_FEATURES, factors), 1e-6)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for k in range(0, len(order), batch):
            picked = [rows[i] for i in order[k : k + batch]]
            lengths = np.array([len(i) for i, _ in picked])
            index, value = (np.concatenate([r[j] for r in picked]) for j in (0, 1))
            raw, sums = m.raw(index, value, spans(lengths))
            slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[order[k : k + batch]]) / len(picked)
            own = np.repeat(slope, lengths) * value
            touched, back = np.unique(index, return_inverse=True)
            g = np.bincount(back, own, len(touched)) + decay * m.weight[touched]
            seen_w[touched] += g**2
            m.weight[touched] -= rate * g / np.sqrt(seen_w[touched])
            pull = own[:, None] * (np.repeat(sums, lengths, axis=0) - m.factor[index] * value[:, None])
            gv = np.stack([np.bincount(back, pull[:, f], len(touched)) for f in range(factors)], axis=1)
            gv += decay * m.factor[touched]
            seen_v[touched] += gv**2
            m.factor[touched] -= rate / 2 * gv / np.sqrt(seen_v[touched])
            m.bias -= rate * float(slope.sum())
    return m


_VECTOR = T.StructType(
    [T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))]
)


def _vectors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, sizes in batches:
        told = iter(sizes.to_pylist())
        found = [features(t, next(told)) for part in slices(texts, texts) for t in as_bytes(part)]
        yield pa.StructArray.from_arrays(
            [
                pa.array([i for i, _ in found], pa.list_(pa.int32())),
                pa.array([v for _, v in found], pa.list_(pa.float64())),
            ],
            ["index", "value"],
        )


def _size(docs: DataFrame):
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> FactorMachine:
    """A machine fitted on at most `sample` labelled documents: those with the smallest id hashes.

    Only their feature vectors come to the driver. Held-out rows are never among them.
    """
    ship_package(docs.sparkSession)
    picked = F.broadcast(sampled_labels(labels, sample))
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), _size(docs).alias("_size"))
        .join(picked, F.col("_id") == F.col("_label_id"))
        .select("_label_id", "_label", arrow_udf(_vectors, _VECTOR)("_text", "_size").alias("x"))
        .orderBy("_label_id", "_label", "x")
        .limit(2 * sample)
        .toArrow()
        .combine_chunks()
    )
    vectors = [
        (np.asarray(x["index"].values, np.int64), np.asarray(x["value"].values, float)) for x in rows["x"]
    ]
    return fit_machine(vectors, rows["_label"].to_numpy().astype(float))


def score_quality(docs: DataFrame, machine: FactorMachine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`.

    Null texts score as empty ones, null or missing n_chars has a bin of its own; repeated rows are
    scored each; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(machine)

    @arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sizes in batches:
            out, told = [np.zeros(0)], iter(sizes.to_pylist())
            for part in slices(texts, texts):
                out.append(model.value.score([features(t, next(told)) for t in as_bytes(part)]))
            yield pa.array(np.concatenate(out))

    return docs.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text", _size(docs)).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
