"""The measures in plain Python, from their definitions, for columns of a few cells."""

from itertools import combinations
from math import inf, log, nan, isnan
from statistics import median

from pyspark.sql import types as T

from tablewarden.sources.lake import Lake

ROWS = T.StructType(
    [
        T.StructField("table_id", T.StringType()),
        T.StructField("row_idx", T.LongType()),
        T.StructField("cells", T.ArrayType(T.StringType())),
    ]
)
COLUMNS = "table_id string, col_idx int, col_name string, base_type string"


def make_lake(spark, tables, kind="object"):
    """A lake of {table_id: [column, ...]} with columns as lists of texts or None."""
    rows = [(t, r, list(cells)) for t, cols in tables.items() for r, cells in enumerate(zip(*cols))]
    meta = [(t, i, f"c{i}", kind) for t, cols in tables.items() for i in range(len(cols))]
    return Lake(spark.createDataFrame(rows, ROWS), spark.createDataFrame(meta, COLUMNS))


def without(column, row):
    return column[:row] + column[row + 1 :]


def uniqueness(column):
    """(ratio, ratio after, dropped row)."""

    def ratio(cells):
        present = [c for c in cells if c is not None]
        return len(set(present)) / len(present) if present else None

    for row, cell in enumerate(column):
        if cell is not None and cell in column[row + 1 :]:
            return ratio(column), ratio(without(column, row)), row
    return ratio(column), ratio(column), None


def compliance(a, b):
    """(ratio, ratio after, dropped row); a missing dependent differs from everything."""

    def ratio(pairs):
        groups = {}
        for k, (x, y) in enumerate(pairs):
            if x is not None:
                groups.setdefault(x, []).append(("missing", k) if y is None else y)
        good = sum(len(set(v)) == 1 for v in groups.values())
        return good / sum(map(len, groups.values())) if good else -1

    pairs = list(zip(a, b))
    before = ratio(pairs)
    if before == -1:
        return -1, -1, None
    seen = {}
    for row, (x, y) in enumerate(pairs):
        if x is None:
            continue
        if x in seen and (y is None or seen[x] is None or seen[x] != y):
            return before, ratio(without(pairs, row)), row
        seen.setdefault(x, y)
    return before, before, None


def top_score(numbers):
    """(largest score, its first row) or None."""
    known = [x for x in numbers if not isnan(x)]
    if not known:
        return None
    mid = median(known)
    if mid == -inf:
        return None
    mad = median([abs(x - mid) for x in known])
    if not mad:
        return None
    best = max(abs(x - mid) / mad for x in known)
    return best, next(r for r, x in enumerate(numbers) if abs(x - mid) / mad == best)


def outlier(numbers):
    """(score, score after, dropped row) or None; numbers are floats, nan if missing."""
    found = top_score(numbers)
    if found is None:
        return None
    after = top_score(without(numbers, found[1]))
    return found[0], after[0] if after else -inf, found[1]


def logs(numbers):
    return [nan if isnan(x) or x < 0 else -inf if x == 0 else log(x) for x in numbers]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def closest(texts):
    """(distance, i, j) of the first closest pair of different texts, or None."""
    pairs = [
        (edit_distance(texts[i], texts[j]), i, j)
        for i, j in combinations(range(len(texts)), 2)
        if texts[i] != texts[j]
    ]
    return min(pairs, default=None)


def spelling(column):
    """(distance, distance after, dropped row, token length) or None."""
    texts = ["nan" if c is None else c for c in column]
    found = closest(texts)
    if found is None:
        return None
    d, i, j = found
    apart = set(texts[i].split()) ^ set(texts[j].split())
    if not apart:
        return None
    left_i, left_j = ((closest(without(texts, r)) or (inf,))[0] for r in (i, j))
    length = sum(map(len, apart)) / len(apart)
    return (d, left_j, j, length) if left_j > left_i else (d, left_i, i, length)
