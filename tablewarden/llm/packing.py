"""Bound-certified packing of documents into sequences.

Pieces are dealt into groups of bounded size, and each group is packed by best fit decreasing. Dual
feasible functions bound the bins a group needs; where its count equals the bound nothing can be
won inside it. Groups with a gap give up every bin that is not full, others those with room for
more than a few ids. What is given up is dealt anew, bin by bin, to fewer groups and packed again; a group keeps the bins it was
given when packing again wins none. Rounds end when one group holds all open bins, none are left,
or the total meets the bound of the whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.bestfit import best_fit_decreasing, bin_bound
from tablewarden.llm.common import slices, tidied
from tablewarden.llm.tokens import REMEMBERED, encoder
from tablewarden.session import ship_package, stage

# Pieces, or bins in later rounds, of a group.
GROUP = 2048
# Share of a bin that must be filled for it to stay closed: in a group with a gap, and in another.
FULL, FULL_CERTIFIED = 1.0, 0.999


def document_pieces(
    docs: DataFrame, capacity: int, tokenizer: str, ranks: str, remembered: int = REMEMBERED, lasting: bool = True
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row's ids and a closing id 0.

    Documents longer than `capacity` are cut into pieces of it; the first piece takes what is over.
    Null texts count as empty: one piece, of the closing id. Repeated rows are cut each for itself,
    null ids stay null, an empty table gives no rows, other columns are not read. `remembered` words
    are kept by each worker, at about 200 bytes: fewer cost time, more memory. Without `lasting` they and
    the vocabulary go at the end of each task, which costs the next one their making.
    """
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces_of(batches)
        finally:
            if not lasting:
                encoder.cache_clear()

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks, remembered)
        for batch in (part for b in batches for part in slices(b, b.column(1))):
            rows: list[list] = [[], [], [], [], []]
            for at, ids in enumerate(encode(batch.column(1))):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if k == 0 else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, x in zip(rows, (at, k, start, length, crc)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows[0], pa.int64())),
                    pa.array(rows[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in rows[2:]],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidied(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def _pack_group(capacity: int, number: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        length = rows["length"].to_numpy()
        # Rows arrive in any order; the packing should not depend on it.
        order = np.lexsort((rows["_item"].to_numpy(), -length))
        rows, length = rows.iloc[order], length[order]
        bins, offsets, made = best_fit_decreasing(length, capacity)
        had, old = np.unique(rows["_bin"].to_numpy(), return_inverse=True)
        if number and len(had) <= made:
            bins, offsets, made = old, rows["offset"].to_numpy(), len(had)
        bound = bin_bound(np.bincount(length, minlength=capacity + 1), capacity)
        filled = np.bincount(bins, length, made)
        opened = filled < capacity * (FULL_CERTIFIED if made <= bound else FULL)
        rows = rows.drop(columns="_group").assign(offset=offsets, _open=opened[bins], _bound=bound)
        return rows.assign(_bin=(number << 56) + (int(key[0]) << 24) + bins)

    return pack


def pack(items: DataFrame, capacity: int, length: str = "length", rounds: int = 6, group: int = GROUP) -> DataFrame:
    """`items` with sequence_id and offset: bins of `capacity`, filled without holes from 0.

    A length must be from 0 to `capacity`. Any other columns are allowed and stay, those of the two
    names excepted. Repeated rows are separate items; null lengths count as 0; an empty table gives
    no rows. Written down between rounds, so that a lost executor repeats one round at most.
    """
    spark = items.sparkSession
    ship_package(spark)
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    start = stage(
        items.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
            F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length"),
        ).withColumn("_item", F.monotonically_increasing_id()),
        "items",
    )
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in start.groupBy("length").count().collect():  # one row for each length at most
        counts[size] = n
    target = bin_bound(counts, capacity)
    schema = "length long, _item long, _bin long, offset long, _open boolean, _bound long"
    now = start.select("length", "_item", F.lit(0).cast("long").alias("_bin"), F.lit(0).cast("long").alias("offset"))
    units, closed, total = int(counts.sum()), [], 0
    for number in range(rounds):
        groups = max(1, -(-units // group))
        dealt = now.withColumn("_group", F.pmod(F.xxhash64(F.lit(number), "_bin" if number else "_item"), F.lit(groups)))
        done = stage(
            dealt.groupBy("_group").applyInPandas(_pack_group(capacity, number), schema), "packed"
        )
        total_now = done.agg(F.count_distinct("_bin"), F.count_distinct(F.when(F.col("_open"), F.col("_bin")))).first()
        bins, opened = total_now
        closed.append(done.where(~F.col("_open")))
        total += bins - opened
        if groups == 1 or opened < 2 or total + opened <= target or number == rounds - 1:
            closed.append(done.where("_open"))
            break
        now, units = done.where("_open").select("length", "_item", "_bin", "offset"), opened
    placed = closed[0]
    for more in closed[1:]:
        placed = placed.union(more)
    placed = placed.select("_item", F.col("_bin").alias("sequence_id"), "offset")
    return start.select("_row", "_item").join(placed, "_item").select("_row.*", "sequence_id", "offset")
