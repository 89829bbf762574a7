"""Closest pairs of texts of short columns, all pairs of many columns at once.

Runs on Arrow batches inside tasks. A distance is counted by bits: a machine word holds one column of
the table of distances (Myers 1999, Hyyro 2003), so the pairs of a batch advance together, one
character at a time. Texts longer than a word are compared one pair at a time, by long integers, unless
their lengths alone keep them from being closest, whichever text is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORD = 64
# Pairs that are compared together.
PAIRS = 16_384


def long_distance(a: str, b: str) -> int:
    """Edit distance of two texts of any length."""
    m = len(a)
    if not m:
        return len(b)
    where: dict[str, int] = {}
    for at, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << at
    full, last = (1 << m) - 1, 1 << m - 1
    up, down, distance = full, 0, m
    for letter in b:
        equal = where.get(letter, 0)
        vertical = equal | down
        level = (((equal & up) + up) ^ up) | equal
        right, left = down | (full & ~(level | up)), up & level
        if right & last:
            distance += 1
        elif left & last:
            distance -= 1
        right, left = right << 1 | 1, left << 1
        up, down = full & (left | ~(vertical | right)), right & vertical & full
    return distance


def short_distances(codes: np.ndarray, sizes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of texts of up to WORD characters, given as rows of padded code points."""
    out = np.empty(len(one), np.int64)
    bits = np.left_shift(np.uint64(1), np.arange(WORD, dtype=np.uint64))
    # Comparing letters is most of the work: a byte each where that holds them.
    numbers = codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes
    # Pairs of like lengths together, so that few steps are taken for the longest alone.
    by_size = np.lexsort((sizes[one], sizes[two]))
    for lo in range(0, len(one), PAIRS):
        at = by_size[lo : lo + PAIRS]
        a, b = one[at], two[at]
        m, n = sizes[a], sizes[b]
        letters = numbers[a, : -(-int(m.max()) // 8) * 8]
        others = np.ascontiguousarray(numbers[b, : n.max()].T)
        last = np.where(m > 0, bits[np.maximum(m, 1) - 1], np.uint64(0))
        up, down = np.full(len(at), ~np.uint64(0)), np.zeros(len(at), np.uint64)
        distance = m.astype(np.int64)
        where = np.zeros((len(at), WORD // 8), np.uint8)
        for step in range(len(others)):
            where[:, : letters.shape[1] // 8] = np.packbits(letters == others[step][:, None], axis=1, bitorder="little")
            equal = where.view("<u8")[:, 0]
            vertical = equal | down
            level = (((equal & up) + up) ^ up) | equal
            right, left = down | ~(level | up), up & level
            change = ((right & last) != 0).astype(np.int64) - ((left & last) != 0)
            distance += np.where(step < n, change, 0)
            right, left = right << np.uint64(1) | np.uint64(1), left << np.uint64(1)
            up, down = left | ~(vertical | right), right & vertical
        out[at] = np.where(m > 0, distance, n)
    return out


def _long_distances(
    texts: list[str], sizes: np.ndarray, one: np.ndarray, two: np.ndarray, words: np.ndarray, out: np.ndarray
) -> None:
    """Distances of the pairs of one column that are not of words, into `out`.

    A pair whose lengths differ by more than the closest known pair without any given text is apart has
    that difference instead: it is neither closest nor closest without a text.
    """
    without = np.full(two[-1] + 1 - one[0], np.iinfo(np.int64).max)

    def note(at: int) -> None:
        a, b = one[at] - one[0], two[at] - one[0]
        kept = without[a], without[b]
        np.minimum(without, out[at], out=without)
        without[a], without[b] = kept

    for at in np.flatnonzero(words):
        note(at)
    out[~words] = np.abs(sizes[one] - sizes[two])[~words]
    long = np.flatnonzero(~words)
    # Like and short texts first: they are sooner compared, and closer.
    for at in long[np.lexsort((sizes[one[long]] + sizes[two[long]], out[long]))]:
        if out[at] <= without.max():
            out[at] = long_distance(texts[one[at]], texts[two[at]])
            note(at)


def _distances(texts: list[str], one: np.ndarray, two: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Distances of all pairs; with the places where the pairs of columns begin, only of those that may be wanted."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    short = sizes <= WORD
    width = -(-int(sizes[short].max(initial=0)) // 8) * 8
    # Beyond the end of a text no letter is read: bits above its last do not reach it.
    codes = np.zeros((len(texts), width), np.uint32)
    joined = "".join(t for t, s in zip(texts, short, strict=True) if s)
    codes[short[:, None] & (np.arange(width) < sizes[:, None])] = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    out = np.empty(len(one), np.int64)
    words = short[one] & short[two]
    out[words] = short_distances(codes, sizes, one[words], two[words])
    if starts is None:
        for at in np.flatnonzero(~words):
            out[at] = long_distance(texts[one[at]], texts[two[at]])
        return out
    ends = np.append(starts[1:], len(one))
    for column in np.unique(np.searchsorted(starts, np.flatnonzero(~words), "right") - 1):
        pairs = slice(starts[column], ends[column])
        _long_distances(texts, sizes, one[pairs], two[pairs], words[pairs], out[pairs])
    return out


@lru_cache(maxsize=128)
def _all_pairs(k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(k, 1)


def _closest(starts: np.ndarray, one: np.ndarray, two: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """First closest pair of every column, and the distances of the closest without either of its texts (or -1)."""
    sizes = np.diff(np.append(starts, len(one)))
    owner = np.repeat(np.arange(len(starts)), sizes)

    def least(values: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(values, starts)

    none = np.iinfo(np.int64).max
    # Pairs are in order, so the first of the smallest is the one with the smallest place.
    best = least(np.where(d == least(d)[owner], np.arange(len(d)), none))
    without = []
    for dropped in (one[best], two[best]):
        kept = (one != dropped[owner]) & (two != dropped[owner])
        left = least(np.where(kept, d, none))
        without.append(np.where(left == none, -1, left))
    return best, *without


def closest_in_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: columns with their `texts` in the order of their rows, to the columns with a pair:
    the places of the closest, its distance, and the distances without its first and second text (or -1)."""
    for batch in batches:
        lists = batch.column("texts")
        sizes = np.diff(lists.offsets.to_numpy())
        texts = lists.flatten().to_pylist()
        firsts = np.append(0, np.cumsum(sizes))[:-1]
        # Few columns at a time, so that their pairs take bounded memory.
        pairs = np.cumsum(sizes * (sizes - 1) // 2)
        begin = 0
        while begin < len(sizes):
            before = pairs[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(pairs, before + 32 * PAIRS, "right")))
            taken = begin + np.flatnonzero(sizes[begin:end] > 1)
            begin = end
            if not len(taken):
                continue
            places = [_all_pairs(int(k)) for k in sizes[taken]]
            counts = np.array([len(p[0]) for p in places])
            base = np.repeat(firsts[taken], counts)
            one = np.concatenate([p[0] for p in places]) + base
            two = np.concatenate([p[1] for p in places]) + base
            lo, hi = firsts[taken[0]], firsts[taken[-1]] + sizes[taken[-1]]
            begins = np.append(0, np.cumsum(counts))[:-1]
            d = _distances(texts[lo:hi], one - lo, two - lo, begins)
            best, d_i, d_j = _closest(begins, one, two, d)
            start = firsts[taken]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(taken)) for c in batch.schema.names if c != "texts"),
                    pa.array((one[best] - start).astype(np.int32)),
                    pa.array((two[best] - start).astype(np.int32)),
                    pa.array(d[best]),
                    pa.array(d_i),
                    pa.array(d_j),
                ],
                names=[*(c for c in batch.schema.names if c != "texts"), "at_i", "at_j", "d", "without_i", "without_j"],
            )
