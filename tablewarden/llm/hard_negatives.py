"""Hard negatives by Kronecker-packed inner products.

Components become whole numbers. Those of several rows, biased so that none is negative, are laid
side by side in fields of one wide integer; one multiplication by an anchor's component then serves
all these rows, and after the sum over components each field holds one exact product. The wide
integer is a double's 53 bits where a field fits, so that sums of products are matrix products; and
Python's integer, of any width, where components are larger.

Rows are dealt into tiles of bounded size. Anchors visit all tiles, once to find their positives and
once, with the positives' scores, to find the negatives; each tile answers with a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewarden.session import ship_package, stage

# Rows of a tile: at most TILE, and fewer while there are fewer tiles than tasks.
TILE, LEAST_TILE = 1 << 17, 1 << 11
# Products held at once.
HELD = 1 << 21
# Fields of one wide integer of Python.
WIDE_FIELDS = 64
LARGEST = (1 << 63) - 1


def whole_components(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers or, where they are too small, as Python's."""
    if not values.size or float(np.abs(values).max()) * scale < 2.0**62:
        return np.floor(values * scale).astype(np.int64)
    # Numbers this large are whole: they are multiplied as integers, which do not overflow.
    flat = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array([*flat, None], object)[:-1].reshape(values.shape)


def packed_products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of all anchors with all rows, both of whole numbers.

    Beyond the range of 64 bits a product counts as the end of that range.
    """
    n, d = rows.shape
    if not (len(anchors) and n and d):
        return np.zeros((len(anchors), n), np.int64)
    most = max(abs(int(anchors.min())), abs(int(anchors.max()))) * max(abs(int(rows.min())), abs(int(rows.max())))
    small = d * most < 1 << 62
    if not small:
        anchors, rows = anchors.astype(object), rows.astype(object)
    low_a, low_r = int(anchors.min()), int(rows.min())
    top_a, top_r = int(anchors.max()) - low_a, int(rows.max()) - low_r
    width = (d * max(top_a, 1) * max(top_r, 1)).bit_length()
    # a·r from the product of what is left of both above their least components.
    fix_a, fix_r = anchors.sum(axis=1) * low_r - d * low_a * low_r, rows.sum(axis=1) * low_a
    a, r = anchors - low_a, rows - low_r
    if small and width <= 53:
        fields = 53 // width
        groups = -(-n // fields)
        r = np.concatenate([r, np.zeros((groups * fields - n, d), np.int64)]).reshape(groups, fields, d)
        wide = (r << (width * np.arange(fields))[None, :, None]).sum(axis=1)
        sums = (a.astype(float) @ wide.T.astype(float)).astype(np.int64)
        parts = (sums[:, :, None] >> (width * np.arange(fields))) & ((1 << width) - 1)
        return parts.reshape(len(a), -1)[:, :n] + fix_a[:, None] + fix_r
    out = np.zeros((len(a), n), np.int64)
    mask = (1 << width) - 1
    a = [[int(x) for x in row] for row in a]
    for start in range(0, n, WIDE_FIELDS):
        block = r[start : start + WIDE_FIELDS]
        wide = [sum(int(x) << (width * f) for f, x in enumerate(column)) for column in block.T]
        for i, components in enumerate(a):
            total = sum(x * w for x, w in zip(components, wide))
            for f in range(len(block)):
                exact = (total >> (width * f) & mask) + int(fix_a[i]) + int(fix_r[start + f])
                out[i, start + f] = max(-LARGEST, min(LARGEST, exact))
    return out


def _best(who: np.ndarray, which: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the first k of every `who`, by score and then by smaller id."""
    order = np.lexsort((ids[which], -score, who))
    who = who[order]
    start = np.searchsorted(who, who)
    return order[np.arange(len(who)) - start < k]


class _Tile:
    """Rows of one length, by label and id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, self.whole = ids[order], labels[order], whole[order]

    def positives(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray, k: int):
        """(anchor, row, score) of the k best other rows with each anchor's label."""
        for label in np.unique(labels).tolist():
            low, high = np.searchsorted(self.labels, [label, label + 1])
            own = np.flatnonzero(labels == label)
            step = max(1, HELD // max(1, high - low))
            for at in (own[i : i + step] for i in range(0, len(own), step)):
                score = packed_products(whole[at], self.whole[low:high])
                other = ids[at][:, None] != self.ids[low:high]
                # Rows below the k-th of all but the anchor itself are out; ties with it stay in.
                ranked = np.where(other, score, -LARGEST)
                last = max(0, high - low - k)
                floor = np.partition(ranked, last, axis=1)[:, last] if high > low else np.zeros(len(at))
                who, which = np.nonzero(other & (score >= floor[:, None]))
                found = score[who, which]
                best = _best(who, which, found, self.ids[low:high], k)
                yield at[who[best]], low + which[best], found[best]

    def negatives(self, labels: np.ndarray, whole: np.ndarray, bounds: np.ndarray, counts: np.ndarray, least: int, k: int):
        """(anchor, positive, row, score) of the k best rows of other labels within reach of each
        positive, whose score is in `bounds`."""
        step = max(1, HELD // max(1, len(self.ids)))
        for start in range(0, len(labels), step):
            part = slice(start, start + step)
            score = packed_products(whole[part], self.whole)
            there = np.arange(bounds.shape[1]) < counts[part, None]
            lowest = np.where(there, bounds[part], LARGEST).min(axis=1)
            highest = np.where(there, bounds[part], -LARGEST).max(axis=1)
            close = (score <= highest[:, None]) & (_percent(score, 100) >= _percent(lowest, least)[:, None])
            who, which = np.nonzero(close & (labels[part, None] != self.labels))
            found = score[who, which]
            for j in range(bounds.shape[1]):
                limit = bounds[part][who, j]
                on = np.flatnonzero(there[who, j] & (found <= limit) & (_percent(found, 100) >= _percent(limit, least)))
                best = on[_best(who[on], which[on], found[on], self.ids, k)]
                yield start + who[best], np.full(len(best), j), which[best], found[best]


def _percent(x: np.ndarray, by: int) -> np.ndarray:
    """x * by, exact whatever the size."""
    if x.size and max(abs(int(x.min())), abs(int(x.max()))) > LARGEST // max(by, 1):
        x = x.astype(object)
    return x * by


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of the vectors of each length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def _tiles(batches: Iterator[pa.RecordBatch], scale: int):
    """For every tile in turn: its rows by length, and a batch of anchors that visit it."""
    now, held, tiles = None, {}, {}
    for batch in batches:
        tile, anchor = batch.column("tile").to_numpy(), batch.column("visits").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(tile) | (np.diff(anchor.astype(int)) != 0)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(tile)]):
            if end == start:
                continue
            part = batch.slice(start, end - start)
            if tile[start] != now:
                now, held, tiles = tile[start], {}, {}
            if not anchor[start]:
                for at, values in _vectors(part.column("embedding")):
                    ids, labels = (part.column(c).to_numpy()[at] for c in ("vec_id", "label"))
                    held.setdefault(values.shape[1], []).append((ids, labels, whole_components(values, scale)))
                continue
            if held:
                tiles = {size: _Tile(*map(np.concatenate, zip(*rows))) for size, rows in held.items()}
                held = {}
            for at, values in _vectors(part.column("embedding")):
                if values.shape[1] in tiles:
                    yield tiles[values.shape[1]], part.take(pa.array(at)), whole_components(values, scale)


def _find_positives(scale: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, anchors, whole in _tiles(batches, scale):
            ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
            for who, which, score in tile.positives(ids, labels, whole, k):
                yield pa.RecordBatch.from_arrays(
                    [anchors.column("row").take(pa.array(who)), pa.array(tile.ids[which]), pa.array(score)],
                    ["row", "positive_id", "positive_score"],
                )

    return run


def _find_negatives(scale: int, least: int, k: int, positives: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, anchors, whole in _tiles(batches, scale):
            n = anchors.num_rows
            counts = anchors.column("positives").value_lengths().to_numpy(zero_copy_only=False)
            flat = anchors.column("positives").flatten()
            on = np.arange(positives) < counts[:, None]
            bounds, named = np.zeros((n, positives), np.int64), np.zeros((n, positives), np.int64)
            bounds[on], named[on] = flat.field("positive_score").to_numpy(), flat.field("positive_id").to_numpy()
            for who, place, which, score in tile.negatives(anchors.column("label").to_numpy(), whole, bounds, counts, least, k):
                yield pa.RecordBatch.from_arrays(
                    [
                        anchors.column("row").take(pa.array(who)),
                        anchors.column("vec_id").take(pa.array(who)),
                        pa.array(place.astype(np.int32)),
                        pa.array(named[who, place]),
                        pa.array(bounds[who, place]),
                        pa.array(tile.ids[which]),
                        pa.array(score),
                    ],
                    ["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"],
                )

    return run


def _first(df: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
    """The first k rows of each key, numbered from 1; Spark keeps k per key and task before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    scale: int = 256,
    tile: int = TILE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, embedding and label; `anchor` is true for the rows to mine for. A component
    x counts as floor(scale * x), and a row's score is its inner product with the anchor. An anchor's
    positives are the first `positives` other rows of its label, and for each of them the first
    `negatives` rows of other labels are returned whose score is at most the positive's and at least
    `least` percent of it. Higher scores come first, ties by smaller vec_id; rank counts from 1.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part.
    Vectors of different lengths have no score. Repeated rows each count, as anchors too; rows with
    an anchor's vec_id are not its others. A product beyond 64 bits counts as the end of that range.
    Anchors without a positive or a negative, and empty tables, give no rows. Other columns are not
    read. Each row is sent to one tile and each anchor to all tiles, twice; `tile` bounds what a task
    holds, 8 bytes per component of its rows and HELD products, and does not change the result.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = stage(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding",
            F.coalesce(anchor, F.lit(False)).alias("visits"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    n = rows.count()
    tiles = max(1, -(-n // tile), min(2 * spark.sparkContext.defaultParallelism, n // LEAST_TILE))
    dealt = rows.withColumns({"tile": F.pmod(F.xxhash64("row"), F.lit(tiles)), "visits": F.lit(False)})
    anchors = rows.where("visits")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long"))).alias("tile")

    def visit(visitors: DataFrame, extra: list[str], run, schema: str) -> DataFrame:
        fields = ["vec_id", "label", "embedding", "row", "visits"]
        sent = visitors.select(*fields, *extra, everywhere)
        both = dealt.select(*fields, "tile").unionByName(sent, allowMissingColumns=True)
        # Rows of a tile first, then the anchors that visit it.
        return both.repartition("tile").sortWithinPartitions("tile", "visits").mapInArrow(run, schema)

    found = visit(anchors, [], _find_positives(scale, positives), "row long, positive_id long, positive_score long")
    best = _first(found, ["row"], "positive_score", "positive_id", positives, "place")
    listed = best.groupBy("row").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))),
            lambda p: F.struct(p["positive_id"].alias("positive_id"), p["positive_score"].alias("positive_score")),
        ).alias("positives")
    )
    known = stage(anchors.join(listed, "row"), "positives")
    mined = visit(
        known,
        ["positives"],
        _find_negatives(scale, least, negatives, positives),
        "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    ranked = _first(mined, ["row", "place"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
