"""Best-fit-decreasing packing of lengths into bins of one capacity, and lower bounds on the bins."""

from __future__ import annotations

import numpy as np


class CapacityTree:
    """Open bins by their room, in a segment tree over room 0..capacity that counts bins.

    `fit(size)` finds the smallest room that is at least `size` in logarithmic time: up from the
    leaf to the first ancestor with bins on its right, then down to the leftmost of them.
    """

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_id: int, room: int) -> None:
        self.bins[room].append(bin_id)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return (bin, its room), or None if no bin has room."""
        count, at = self.count, size + self.width
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.width
        self._add(room, -1)
        return self.bins[room].pop(), room

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.count[at] += by
            at >>= 1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins; items longer than `capacity` are an error.

    Items of length zero go into bin 0, which exists if there is any item. Ties keep the order given.
    """
    if len(lengths) and lengths.max() > capacity:
        raise ValueError("an item is longer than the capacity")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, made = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, made = (made, capacity), made + 1
        bins[i], offsets[i] = found[0], capacity - found[1]
        tree.put(found[0], found[1] - size)
    return bins, offsets, made


def bin_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least; counts[s] items have length s.

    The largest of three families of dual feasible functions, taken over all their parameters in
    whole numbers: the total; items over capacity - e count whole and those under e not at all;
    items over half count by how many of size e fit beside them, and others of e or more count as
    one of those.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    if not counts[1:].any():
        return max(best, int(counts.any()))
    upto, mass = np.cumsum(counts), np.cumsum(counts * size)
    half = capacity // 2
    e = np.arange(1, half + 1)
    over = upto[-1] - upto[capacity - e]
    middle = mass[capacity - e] - mass[e - 1]
    best = max(best, int(np.max(over + -(-middle // capacity))))
    big = np.flatnonzero(counts[half + 1 :]) + half + 1
    for k in np.unique(capacity // e).tolist():
        least = capacity // (k + 1) + 1 if capacity // (k + 1) + 1 <= half else half
        least = max(1, least)
        fits = capacity // least
        units = int((counts[big] * (fits - (capacity - big) // least)).sum())
        units += int(upto[half] - upto[least - 1])
        best = max(best, -(-units // fits))
    return best
