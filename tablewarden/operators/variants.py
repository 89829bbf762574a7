"""Hashes of a long text without each of its characters, in time linear in the text.

Built-in functions would cut and hash the text once per position. Runs on Arrow batches inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Four remainders of 31 bits make 124 bits: equal hashes stand for equal texts.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579)
BASES = (1_220_703_125, 1_977_326_743, 1_162_261_467, 1_801_088_541)
BATCH_ROWS = 65_536


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    powers = np.ones(n, np.int64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        powers[have : have + more] = powers[:more] * step % prime
        have, step = have + more, step * step % prime
    return powers


def left_out_hashes(text: str) -> np.ndarray:
    """Rows of two integers: the text without each character in turn, and last the whole text.

    Comparable between texts: a row is the hash of what is left, times the base.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    n = len(codes)
    parts = []
    for prime, base in zip(PRIMES, BASES, strict=True):
        sums = np.zeros(n + 1, np.int64)
        np.cumsum(codes * _powers(base, n, prime) % prime, out=sums[1:])
        before = np.append(sums[:-1], sums[-1]) % prime * base
        after = np.append(sums[-1] - sums[1:], 0)
        parts.append((before + after) % prime)
    return np.stack([parts[0] << 31 | parts[1], parts[2] << 31 | parts[3]], axis=1)


def _binary(hashes: np.ndarray) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(hashes).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hashes), [None, data]).cast(pa.binary())


def variant_rows(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (keys, first_row, text) to (keys, first_row, gap, rest, centre).

    A row for every position left out (gap > 0), for every different text that leaving out one
    character gives (gap 0) and for the whole text (gap 0, centre).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.select([*keys, "first_row"])
            for at, text in enumerate(batch.column("text").to_pylist()):
                hashes = left_out_hashes(text)
                n = len(hashes) - 1
                once = np.unique(hashes[:-1], axis=0)
                rest = np.concatenate([hashes[:-1], once, hashes[-1:]])
                gap = np.zeros(len(rest), np.int32)
                gap[:n] = np.arange(1, n + 1)
                centre = np.zeros(len(rest), bool)
                centre[-1] = True
                for lo in range(0, len(rest), BATCH_ROWS):
                    hi = min(lo + BATCH_ROWS, len(rest))
                    owner = named.take(pa.array(np.full(hi - lo, at, np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [*owner.columns, pa.array(gap[lo:hi]), _binary(rest[lo:hi]), pa.array(centre[lo:hi])],
                        names=[*keys, "first_row", "gap", "rest", "centre"],
                    )

    return run
