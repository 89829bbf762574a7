"""Quality rules: boosted trees over statistics of a document, behind two fixed rules.

Statistics are taken in Arrow batches, one pass over every whole text. Trees are grown on a bounded
sample of labelled rows by histograms of the statistics, with monotonic constraints, and scored as
flat node arrays, all rows of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from tablewarden.llm.common import SPACES, as_bytes, give_back, sampled_labels, slices
from tablewarden.session import ship_package

SYMBOLS = b"#*$%&|<>"
# Words that a document must have, and how likely label 1 must be.
LEAST_WORDS, THRESHOLD = 50, 0.5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Statistics the trees see, with the direction a score may move as one grows: 1 up, -1 down, 0 either.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "distinct_word_share": 1,
    "capital_share": -1,
    "mark_share": -1,
    "bar_share": -1,
    "stop_share": 0,
    "digit_share": 0,
    "words_per_line": 0,
}
_OF = {name: np.array(list(chars)) for name, chars in {
    "space": SPACES, "symbol": SYMBOLS, "capital": bytes(range(65, 91)), "mark": b"!?",
    "bar": b"|", "stop": b".,;:", "digit": b"0123456789",
}.items()}


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside a window of three that is found twice or more; `ids` number equal words alike."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
    code = pairs[:-1] * kinds + ids[2:]
    _, where, count = np.unique(code, return_inverse=True, return_counts=True)
    again = count[where] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The exact counts of COUNTS and the values of FEATURES of one text."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = {name: int(byte[at].sum()) for name, at in _OF.items()}
    chars = len(text) - int(byte[0x80:0xC0].sum()) - of["space"]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(ids, len(number))
    n, c = max(1, len(words)), max(1, chars)
    return [len(words), chars, of["symbol"], dup_lines, repeated], [
        float(np.log1p(len(words))),
        chars / n,
        of["symbol"] / c,
        dup_lines / max(1, len(lines)),
        repeated / n,
        len(number) / n,
        of["capital"] / c,
        of["mark"] / n,
        of["bar"] / n,
        of["stop"] / n,
        of["digit"] / c,
        len(words) / max(1, len(lines)),
    ]


_STATS = T.StructType(
    [*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("features", T.ArrayType(T.DoubleType()))]
)


def _text_statistics(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = [statistics(t) for part in slices(texts, texts) for t in as_bytes(part)]
        counts = np.array([x for x, _ in found], np.int64).reshape(-1, len(COUNTS))
        features = pa.array([x for _, x in found], pa.list_(pa.float64()))
        yield pa.StructArray.from_arrays(
            [*[pa.array(counts[:, i]) for i in range(len(COUNTS))], features], [*COUNTS, "features"]
        )
    give_back()


def text_statistics(text: str) -> Column:
    """Struct of COUNTS and features."""
    return arrow_udf(_text_statistics, _STATS)(text)


@dataclass
class Trees:
    """All trees in one set of arrays; a leaf points to itself, so `depth` steps reach a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for the rows of `x`."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


@dataclass
class _Nodes:
    feature: list = field(default_factory=list)
    threshold: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def leaf(self, value: float) -> int:
        at = len(self.value)
        for items, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, at), (self.right, at), (self.value, value)):
            items.append(x)
        return at


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    directions: list[int],
    trees: int = 40,
    depth: int = 3,
    rate: float = 0.25,
    bins: int = 48,
    penalty: float = 1.0,
    least: float = 2.0,
) -> Trees:
    """Second-order boosting of the logistic loss.

    A split on a constrained feature counts only if its sides' values run in the given direction,
    and both sides' subtrees are held on their side of the middle value; so the score of the whole
    is monotonic in that feature. With no rows or one label the trees are empty and the score is
    the smoothed share of label 1.
    """
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    nodes, roots = _Nodes(), []
    base = float(np.log(share / (1 - share)))
    if len(y) and y.min() < y.max():
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        total = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            at = nodes.leaf(float(np.clip(-gs / (hs + penalty), low, high)) * rate)
            if level == depth or hs < 2 * least:
                return at
            best = (1e-6, -1, 0, 0.0)
            for f, direction in enumerate(directions):
                k = len(edges[f]) + 1
                if k < 2:
                    continue
                gl = np.cumsum(np.bincount(codes[rows, f], g[rows], k))[:-1]
                hl = np.cumsum(np.bincount(codes[rows, f], h[rows], k))[:-1]
                gr, hr = gs - gl, hs - hl
                vl = np.clip(-gl / (hl + penalty), low, high)
                vr = np.clip(-gr / (hr + penalty), low, high)
                gain = -(gl * vl + (hl + penalty) * vl**2 / 2) - (gr * vr + (hr + penalty) * vr**2 / 2)
                whole = np.clip(-gs / (hs + penalty), low, high)
                gain += gs * whole + (hs + penalty) * whole**2 / 2
                ok = (hl >= least) & (hr >= least) & (direction * (vr - vl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                s = int(np.argmax(gain))
                if gain[s] > best[0]:
                    best = (float(gain[s]), f, s, float(vl[s] + vr[s]) / 2)
            _, f, s, middle = best
            if f < 0:
                return at
            goes = codes[rows, f] <= s
            up, down = directions[f] > 0, directions[f] < 0
            left = grow(rows[goes], g, h, level + 1, middle if down else low, middle if up else high)
            right = grow(rows[~goes], g, h, level + 1, middle if up else low, middle if down else high)
            nodes.feature[at], nodes.threshold[at] = f, float(edges[f][s])
            nodes.left[at], nodes.right[at] = left, right
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
            one = _flat(nodes, roots[-1:], depth, 0.0)
            q = np.clip(one.score(x), 1e-12, 1 - 1e-12)
            total += np.log(q / (1 - q))
    return _flat(nodes, roots, depth, base)


def _flat(nodes: _Nodes, roots: list[int], depth: int, base: float) -> Trees:
    return Trees(
        np.array(nodes.feature, np.int64), np.array(nodes.threshold), np.array(nodes.left, np.int64),
        np.array(nodes.right, np.int64), np.array(nodes.value), np.array(roots, np.int64), depth, base,
    )


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Trees:
    """Trees fitted on at most `sample` labelled documents: those with the smallest id hashes.

    Only the sample's statistics come to the driver. Rows that are held out are never in the sample.
    """
    ship_package(docs.sparkSession)
    picked = F.broadcast(sampled_labels(labels, sample))
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .join(picked, F.col("_id") == F.col("_label_id"))
        .select("_label_id", "_label", text_statistics("_text").features.alias("x"))
        .orderBy("_label_id", "_label", "x")
        .limit(2 * sample)
        .toArrow()
    )
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["_label"].to_numpy().astype(float), list(FEATURES.values()))


def _verdicts(docs: DataFrame, row: Column, trees: Trees, least_words: int, threshold: float) -> DataFrame:
    """_row, what `row` says of each row of `docs`, and quality."""
    spark = docs.sparkSession
    ship_package(spark)
    model = spark.sparkContext.broadcast(trees)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in batches:
            rows = np.asarray(x.flatten(), float).reshape(-1, len(FEATURES))
            yield pa.array(model.value.score(rows))
        give_back()

    taken = docs.select(row.alias("_row"), text_statistics("text").alias("_counts"))
    scored = taken.withColumn("_score", score("_counts.features"))
    failed = (F.col("_counts.n_words") < least_words) | (
        100 * F.col("_counts.n_repeat_words") > 50 * F.col("_counts.n_words")
    )
    return scored.select(
        "_row",
        F.struct(
            *[F.col(f"_counts.{c}") for c in COUNTS],
            failed.alias("base_failed"),
            F.col("_score").alias("score"),
            (~failed & (F.col("_score") >= threshold)).alias("kept"),
        ).alias("quality"),
    )


def judge(docs: DataFrame, trees: Trees, least_words: int = LEAST_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with a struct column `quality`: the counts, base_failed, score and kept.

    base_failed: fewer than `least_words` words, or over half the words in repeated windows of
    three. Others are kept if the trees give label 1 at least `threshold`. All columns of `docs`
    stay, one of the name `quality` excepted, which is replaced. Null and empty texts have no words
    and fail; repeated rows get equal verdicts, each its own; an empty table gives no rows.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "quality"])
    return _verdicts(docs, own, trees, least_words, threshold).select("_row.*", "quality")


def filter_quality(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    verdict = _verdicts(docs, F.struct("*"), learn(docs, labels, sample), LEAST_WORDS, THRESHOLD)
    return verdict.where("quality.kept").select("_row.*")
