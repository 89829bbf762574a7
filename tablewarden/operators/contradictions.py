"""Contradicted determinant values of whole tables, for all column pairs at once.

Runs on Arrow batches inside tasks. What is sorted are numbers of a bounded chunk of tables; no row is
repeated per column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Rows that are taken together; a larger table is taken alone.
CHUNK_ROWS = 131_072
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
OUT = ("table_id", "col_1_idx", "col_2_idx", "violated", "code")


def _matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and whether they are there, a row per list."""
    flat = lists.flatten()
    known = pc.is_valid(flat).to_numpy(zero_copy_only=False)
    return flat.fill_null(0).to_numpy().reshape(-1, width), known.reshape(-1, width)


def _in_groups(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal (table, x, y) together, rows in order, and where a group begins."""

    def begins(order: np.ndarray) -> np.ndarray:
        new = np.ones(len(order), bool)
        new[1:] = False
        for part in (table, x, y):
            sorted_part = part[order]
            new[1:] |= sorted_part[1:] != sorted_part[:-1]
        return new

    mixed = table.astype(np.uint64) * MIX[0] + x.view(np.uint64) * MIX[1] + y.view(np.uint64) * MIX[2]
    order = np.argsort(mixed, kind="stable")
    new = begins(order)
    mixed = mixed[order]
    if (new[1:] & (mixed[1:] == mixed[:-1])).any():  # different groups of one number
        order = np.lexsort((y, x, table))
        new = begins(order)
    return order, new


def _of_width(table: np.ndarray, row: np.ndarray, x: np.ndarray, known: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """(table, col_1, col_2, violated, code) arrays of tables of one width, rows in order."""
    width = x.shape[1]
    for one in range(width - 1):
        there = np.flatnonzero(known[:, one])
        if len(there) < 2:
            continue
        order, new = _in_groups(table[there], x[there, one], y[there, one])
        later = np.flatnonzero(~new)
        group = np.cumsum(new)[later] - 1
        first, later = there[order[np.flatnonzero(new)[group]]], there[order[later]]
        for two in range(one + 1, width):
            # A missing dependent equals nothing.
            differs = np.flatnonzero(~(known[later, two] & known[first, two] & (x[later, two] == x[first, two])))
            if not len(differs):
                continue
            of_value = group[differs]
            at = np.flatnonzero(np.append(True, of_value[1:] != of_value[:-1]))
            # Repaired by dropping the first row that differs if no other does.
            alone = np.diff(np.append(at, len(differs))) == 1
            found = later[differs[at]]
            code, owner = row[found] * 2 + alone, table[found]
            by_table = np.argsort(owner, kind="stable")
            code, owner = code[by_table], owner[by_table]
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            yield owner[at], one, two, np.diff(np.append(at, len(owner))), np.minimum.reduceat(code, at)


def _contradicted(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    ids = rows["table_id"].combine_chunks().dictionary_encode()
    table = ids.indices.to_numpy().astype(np.int64)
    row = rows["row_idx"].to_numpy()
    in_order = np.lexsort((row, table))
    x, y = (rows[c].combine_chunks() for c in ("x", "y"))
    widths = pc.list_value_length(x).to_numpy()
    for width in np.unique(widths):
        of = in_order[widths[in_order] == width]
        taken = pa.array(of)
        numbers, known = _matrix(x.take(taken), width)
        others, _ = _matrix(y.take(taken), width)
        for owner, one, two, violated, code in _of_width(table[of], row[of], numbers, known, others):
            n = len(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.dictionary.take(pa.array(owner)),
                    pa.array(np.full(n, one, np.int32)),
                    pa.array(np.full(n, two, np.int32)),
                    pa.array(violated.astype(np.int64)),
                    pa.array(code.astype(np.int64)),
                ],
                names=list(OUT),
            )


def contradictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (table_id, row_idx, x, y), tables whole and one after the other, to OUT.

    x and y are two hashes of every cell. violated and code are those of `dependency.violations`.
    """
    held: list[pa.RecordBatch] = []
    n, enough = 0, CHUNK_ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows["table_id"]
        # The last table may go on in the next batch.
        whole = pc.index(ids, ids[n - 1]).as_py()
        if whole:
            yield from _contradicted(rows.slice(0, whole))
        held = rows.slice(whole).combine_chunks().to_batches()
        n -= whole
        enough = max(CHUNK_ROWS, 2 * n)
    if n:
        yield from _contradicted(pa.Table.from_batches(held))
