"""Closest pairs of short columns, against all pairs by the definition."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tablewarden.operators import closest as module
from tablewarden.operators.spelling import _short_columns


def distance(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


@pytest.mark.parametrize("letters", ["ab", "abcé😀\x00"])
def test_distances(monkeypatch, letters):
    monkeypatch.setattr(module, "PAIRS", 7)
    draw = random.Random(len(letters))
    sizes = [0, 1, 2, 5, 8, 9, 63, 64, 65, 90]
    texts = ["".join(draw.choice(letters) for _ in range(draw.choice(sizes))) for _ in range(25)]
    one, two = np.triu_indices(len(texts), 1)
    assert module._distances(texts, one, two).tolist() == [
        distance(texts[i], texts[j]) for i, j in zip(one, two, strict=True)
    ]


@pytest.mark.parametrize("pairs", [1, 1000])
def test_closest_in_columns(monkeypatch, pairs):
    monkeypatch.setattr(module, "PAIRS", pairs)
    draw = random.Random(3)
    columns = [["".join(draw.choice("ab") for _ in range(draw.randint(0, 5))) for _ in range(k % 6)] for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(columns, pa.list_(pa.string()))], names=["k", "texts"])
    got = {}
    for out in module.closest_in_columns([batch.slice(0, 11), batch.slice(11)]):
        got |= {r.pop("k"): tuple(r.values()) for r in out.to_pylist()}
    expected = {}
    for k, texts in enumerate(columns):
        found = sorted((distance(texts[i], texts[j]), i, j) for j in range(len(texts)) for i in range(j))
        if found:
            d, i, j = found[0]
            left = [min((p[0] for p in found if end not in p[1:]), default=-1) for end in (i, j)]
            expected[k] = (i, j, d, *left)
    assert got == expected


def test_long_pairs_that_cannot_be_closest_are_not_compared(monkeypatch):
    draw = random.Random(8)
    columns = [["".join(draw.choice("abc") for _ in range(draw.randint(0, 180))) for _ in range(k % 7)] for k in range(40)]
    compared = []
    whole = module.long_distance
    monkeypatch.setattr(module, "long_distance", lambda a, b: compared.append((a, b)) or whole(a, b))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(columns, pa.list_(pa.string()))], names=["k", "texts"])
    got = {r.pop("k"): tuple(r.values()) for out in module.closest_in_columns([batch]) for r in out.to_pylist()}
    expected, long = {}, 0
    for k, texts in enumerate(columns):
        found = sorted((distance(texts[i], texts[j]), i, j) for j in range(len(texts)) for i in range(j))
        long += sum(max(len(texts[i]), len(texts[j])) > 64 for _, i, j in found)
        if found:
            d, i, j = found[0]
            expected[k] = (i, j, d, *(min((p[0] for p in found if end not in p[1:]), default=-1) for end in (i, j)))
    assert got == expected and len(compared) < long


def test_short_columns_compare_in_batches(spark):
    """Pairs are compared many at a time, and missing second distances stay missing."""
    rows = [("t", 0, "abc", 1, 4), ("t", 0, "abd", 2, 1), ("u", 0, "x", 1, 0), ("t", 1, "a", 1, 0), ("t", 1, "bb", 1, 3), ("t", 1, "bc", 1, 9)]
    values = spark.createDataFrame(rows, "table_id string, col_idx int, text string, n long, first_row long")
    found = _short_columns(values)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [
        ("t", 0, 1, 1, 4, "abd", "abc", 1, None),
        ("t", 1, 1, 3, 9, "bb", "bc", 2, 2),
    ]
