"""Near-duplicate vectors by cosine: 8-bit tile products with rigorous error bounds.

Vectors are scaled to length one and rounded to signed bytes with a scale of their own. What rounding
left over has a known length, so the true cosine of two vectors lies within a known distance of the
scaled product of their bytes. A tile product decides most pairs from the bytes alone; the pairs the
bounds leave open are computed in double precision.

The cosines of unrelated vectors do not rule each other out, so all tiles meet: the arithmetic is
square in the vectors, what is shuffled is the vectors once for every tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.components import components
from tablewarden.session import ship_package, stage

TILE = 4096
# Rows of one tile compared with the other tile at once: bounds a task's working memory.
STRIP = 256
# Products of bytes over this many components are whole numbers below 2^24, exact in 32-bit floats.
EXACT = 1024
# Slack for rounding in double precision while quantising, and in single while comparing.
SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, scales, lengths of the rounded vectors and of what rounding left, for unit vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    rounded = code * scale[:, None]
    return code, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(unit - rounded, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of all rows of signed bytes `a` with those of `b`, as floats."""
    if a.shape[1] <= EXACT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    parts = range(0, a.shape[1], EXACT)
    return sum((a[:, k : k + EXACT].astype(np.float32) @ b[:, k : k + EXACT].astype(np.float32).T).astype(float) for k in parts)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows of two tiles, or inside one if `y` is None.

    Returns for each row of x, then of y, the number of its links, and a label: equal labels are
    connected by the links. Rows are vectors as they came, in double precision.
    """
    both = [v / np.abs(v).max(axis=1)[:, None] for v in ((x,) if y is None else (x, y))]
    both = [v / np.linalg.norm(v, axis=1)[:, None] for v in both]
    quantised = [quantise(u) for u in both]
    (cx, sx, lx, ex), (cy, sy, ly, ey) = quantised[0], quantised[-1]
    ux, uy = both[0], both[-1]
    base = 0 if y is None else len(x)
    count = np.zeros(len(x) + (0 if y is None else len(y)), np.int64)
    label = np.arange(len(count))
    widest, most = float(ey.max()), float(ly.max())
    scaled_y = sy.astype(np.float32)
    for k in range(0, len(x), STRIP):
        rows = slice(k, min(k + STRIP, len(x)))
        first = k if y is None else 0
        near = products(cx[rows], cy[first:]) * scaled_y[first:]
        # The largest error any vector of the other tile can have with this row.
        err = lx[rows] * widest + ex[rows] * (most + widest) + SLACK
        i, j = np.nonzero(near >= ((threshold - err) / sx[rows])[:, None].astype(np.float32) * np.float32(1 - 1e-6))
        if not len(i):
            continue
        i, j, close = i + k, j + first, near[i, j].astype(float) * sx[i + k]
        if y is None:
            later = j > i
            i, j, close = i[later], j[later], close[later]
        own = lx[i] * ey[j] + ex[i] * ly[j] + ex[i] * ey[j] + SLACK
        sure = close - own >= threshold
        for a in range(0, len(i), 1 << 16):
            open_ = a + np.flatnonzero(~sure[a : a + (1 << 16)])
            sure[open_] = np.einsum("nd,nd->n", ux[i[open_]], uy[j[open_]]) >= threshold
        i, j = i[sure], j[sure] + base
        count += np.bincount(i, minlength=len(count)) + np.bincount(j, minlength=len(count))
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return count, label


def _read(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Row numbers, ids and vectors of one tile."""
    at = np.concatenate([np.frombuffer(x, "<i8") for x in rows["rows"]])
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in rows["ids"]])
    vectors = [v for d, blob in zip(rows["dim"], rows["vectors"]) for v in np.frombuffer(blob, "<f8" if d < 0 else "<f4").reshape(-1, abs(d))]
    return at, ids, vectors


def _by_length(vectors: list[np.ndarray]) -> dict[int, np.ndarray]:
    """Places of the vectors, by their number of components."""
    lengths = np.array([len(v) for v in vectors])
    return {int(d): np.flatnonzero(lengths == d) for d in np.unique(lengths)}


def _unit(threshold: float):
    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """One row for each vector with links in this pair of tiles: how many, and a smallest id."""
        parts = [_read(r) for _, r in rows.sort_values("tile").groupby("tile")]
        if len(parts) == 1 and key[0] != key[1]:
            return pd.DataFrame({"row": [], "vec_id": [], "links": [], "root": []}).astype("int64")
        found = []
        split = [_by_length(p[2]) for p in parts]
        for d, mine in split[0].items():
            theirs = split[-1].get(d)
            if theirs is None:
                continue
            x = np.stack([parts[0][2][i] for i in mine]).astype(float)
            y = None if len(parts) == 1 else np.stack([parts[1][2][i] for i in theirs]).astype(float)
            count, label = tile_links(x, y, threshold)
            row = parts[0][0][mine] if y is None else np.concatenate([parts[0][0][mine], parts[1][0][theirs]])
            ids = parts[0][1][mine] if y is None else np.concatenate([parts[0][1][mine], parts[1][1][theirs]])
            least = np.full(len(label), np.iinfo(np.int64).max)
            np.minimum.at(least, label, ids)
            on = count > 0
            found.append(pd.DataFrame({"row": row[on], "vec_id": ids[on], "links": count[on], "root": least[label[on]]}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "vec_id": [], "links": [], "root": []}).astype("int64")

    return links


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one tile and length in binary cells; a batch gives one row for each of them it meets."""
    for batch in batches:
        tile, row, ids = (np.asarray(batch.column(k), np.int64) for k in range(3))
        vectors = batch.column(3)
        size = np.asarray(vectors.value_lengths(), np.int64)
        flat = np.asarray(vectors.flatten())
        flat = flat.astype("<f4" if flat.dtype == np.float32 else "<f8")
        start = np.concatenate([[0], np.cumsum(size)])
        out: list[list] = [[], [], [], [], []]
        order = np.lexsort((row, size, tile))
        for own in np.split(order, np.flatnonzero(np.diff(tile[order]) | np.diff(size[order])) + 1):
            if not len(own):
                continue
            d = int(size[own[0]])
            cells = flat[start[own][:, None] + np.arange(d)]
            for column, x in zip(out, (tile[own[0]], d if flat.dtype == np.float32 else -d, row[own].astype("<i8").tobytes(), ids[own].astype("<i8").tobytes(), cells.tobytes())):
                column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["tile", "dim", "rows", "ids", "vectors"])


def link_vectors(vectors: DataFrame, threshold: float = 0.95, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Pairs link at a cosine of `threshold` or more. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, as do those of different lengths with each other, and
    rows with a null id; these have their own id as component. Rows that repeat an id are vectors of
    their own that link and count, and one node of the components. An empty table gives no rows;
    other columns are not read. The threshold must be above 0.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    embedding = F.col("embedding")
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("vec_id").isNotNull() & finite & F.exists(embedding, lambda c: c != 0)
    rows = stage(
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.when(F.coalesce(usable, F.lit(False)), embedding).alias("embedding"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "vectors",
    )
    good = rows.where(F.col("embedding").isNotNull())
    tiles = max(1, -(-good.count() // tile))
    placed = good.select(F.pmod(F.xxhash64("_row"), F.lit(tiles)).alias("tile"), "_row", "vec_id", "embedding")
    packed = placed.mapInArrow(_tiles, "tile long, dim int, rows binary, ids binary, vectors binary")
    met = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tiles - 1).cast("long")))).select(
        F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "dim", "rows", "ids", "vectors"
    )
    links = stage(
        met.groupBy("low", "high").applyInPandas(_unit(threshold), "row long, vec_id long, links long, root long"),
        "links",
    )
    counts = stage(links.groupBy("row").agg(F.sum("links").alias("n_links")), "counts")
    tied = components(links.select("vec_id", "root"), "vec_id", "root")
    done = rows.select("_row", F.col("vec_id").alias("_id")).join(counts, F.col("_row") == F.col("row"), "left")
    done = done.join(tied, F.col("_id") == F.col("node"), "left").select(
        F.col("_id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "_id").alias("component_id"),
    )
    return done.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
