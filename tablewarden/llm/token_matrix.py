"""Token ids of documents as packed matrices in binary columns.

Each task packs what it reads, window by window: nothing is shuffled, a lost executor costs the
tasks it ran, and memory is bounded by the window. Rows of the matrices are filled by best fit
decreasing with a segment tree that finds the fullest row with room.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.bestfit import best_fit_decreasing
from tablewarden.llm.common import slices
from tablewarden.llm.tokens import encoder, largest_id
from tablewarden.session import ship_package

_SEGMENT = "struct<doc_id:{}, start:bigint, length:int>"


def token_matrix(
    docs: DataFrame,
    capacity: int,
    tokenizer: str,
    ranks: str,
    end_id: int = 0,
    pad_id: int = 0,
    window: int = 1 << 21,
) -> DataFrame:
    """One row per packed sequence.

    sequence_id (unique), input_ids (`capacity` little-endian ids, padded with `pad_id`),
    cu_seqlens (0, then the end of every segment), position_ids (places within the segment, 0 again
    at every start and on padding), segments (which document, from which of its ids, how many).
    Ids take 16 bits if the whole vocabulary fits, positions if `capacity` does, else 32. Which
    segments share a sequence depends on how the table is partitioned; the segments do not.

    A document's ids are followed by `end_id`; longer documents are cut losslessly into segments.
    Null and empty texts have that id alone; null ids stay null; repeated rows are separate
    documents; an empty table gives no rows; other columns are not read. `window` is about how many
    ids a task holds before it packs them.
    """
    ship_package(docs.sparkSession)
    # One width for all rows, whatever ids a window holds.
    wide = max(largest_id(tokenizer), end_id, pad_id) >= 1 << 16

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        made = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        total = 0
        kind: pa.DataType | None = None

        def flush() -> pa.RecordBatch:
            nonlocal held, total, made
            lengths = np.array([len(x[2]) for x in held], np.int64)
            rows, offsets, n = best_fit_decreasing(lengths, capacity)
            ids = np.full((n, capacity), pad_id, "<u4" if wide else "<u2")
            places = np.zeros((n, capacity), "<u4" if capacity > 1 << 16 else "<u2")
            order = np.lexsort((offsets, rows))
            for i in order.tolist():
                r, o, x = rows[i], offsets[i], held[i][2]
                ids[r, o : o + len(x)] = x
                places[r, o : o + len(x)] = np.arange(len(x))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)
            ends = (offsets + lengths)[order]
            batch = pa.RecordBatch.from_arrays(
                [
                    pa.array(made + np.arange(n)),
                    pa.array([x.tobytes() for x in ids], pa.binary()),
                    pa.array([[0, *ends[a:b]] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int32())),
                    pa.array([x.tobytes() for x in places], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(cuts),
                        pa.StructArray.from_arrays(
                            [
                                pa.array([held[i][0] for i in order], kind),
                                pa.array([held[i][1] for i in order], pa.int64()),
                                pa.array(lengths[order].astype(np.int32)),
                            ],
                            ["doc_id", "start", "length"],
                        ),
                    ),
                ],
                ["sequence_id", "input_ids", "cu_seqlens", "position_ids", "segments"],
            )
            made, held, total = made + n, [], 0
            return batch

        for batch in (part for b in batches for part in slices(b, b.column(1))):
            kind = batch.column(0).type
            for doc_id, found in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                ids = np.append(np.frombuffer(found, "<u4"), np.uint32(end_id))
                for start in range(0, len(ids), capacity):
                    held.append((doc_id, start, ids[start : start + capacity]))
                total += len(ids)
                if total >= window:
                    yield flush()
        if held:
            yield flush()

    segment = _SEGMENT.format(docs.schema["doc_id"].dataType.simpleString())
    return docs.select("doc_id", "text").mapInArrow(
        write,
        f"sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, segments array<{segment}>",
    )


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Parquet files of the sequences; each is readable by numpy.frombuffer on its binary columns."""
    matrix.write.mode("overwrite").option("compression", "zstd").parquet(path)


def digest(matrix: DataFrame) -> DataFrame:
    """One row per segment: where it lies, and checksums of its sequence."""
    return matrix.select(
        "sequence_id",
        F.crc32("input_ids").alias("ids_crc32"),
        F.crc32("position_ids").alias("positions_crc32"),
        "cu_seqlens",
        F.posexplode("segments").alias("segment", "s"),
    ).select(
        F.col("s.doc_id").alias("doc_id"),
        F.col("s.start").alias("start"),
        F.col("s.length").cast("long").alias("length"),
        "sequence_id",
        "segment",
        F.get("cu_seqlens", F.col("segment")).cast("long").alias("offset"),
        "ids_crc32",
        "positions_crc32",
    )
