import random
from math import inf, isnan, nan

from pyspark.sql import functions as F

from tablewarden.operators.selection import at_ranks

def ranks():
    half = F.floor(F.col("total") / 2)
    return {"low": half - 1, "mid": half, "top": F.col("total") - 1}


def columns():
    rng = random.Random(5)
    return {
        "one": [3.5],
        "ties": [2.0] * 40 + [7.0] * 3,
        "halves": [1.0 + i * 1e-9 for i in range(50)] + [1e9 + i for i in range(50)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308) for _ in range(120)] + [0.0, -0.0, 5e-324],
        "near": [1.0 + i * 2.0**-52 for i in range(90)],
        "edges": [-inf, -inf, inf, 0.0, -1.0, 1.0, nan],
        "nines": [-9.0, -8.5, -8.0, -7.9, -7.8, -7.7],
    }


def expected(numbers):
    order = sorted(numbers, key=lambda x: (isnan(x), 0 if isnan(x) else x))
    half = len(order) // 2
    return order[half - 1] if half else None, order[half], order[-1]


def same(a, b):
    return a == b or (a is not None and b is not None and isnan(a) and isnan(b))


def test_ranks_by_histograms_of_any_size(spark):
    """Adjacent ranks far apart, equal logarithms, whole range of doubles, infinities, weights."""
    rows = []
    for k, numbers in columns().items():
        counts = {}
        for x in numbers:
            counts[repr(x)] = counts.get(repr(x), 0) + 1
        rows += [(k, float(text), n, i) for i, (text, n) in enumerate(counts.items())]
    df = spark.createDataFrame(rows, "k string, x double, n long, row long").repartition(3)
    for limit, bins, single in ((1000, 4096, 50_000), (0, 16, 5)):
        found = at_ranks(df, ["k"], "x", ranks(), 200, limit, bins, single).collect()
        assert len(found) == len(columns())
        for r in found:
            numbers = columns()[r.k]
            assert r.total == len(numbers), r
            assert all(map(same, (r.low, r.mid, r.top), expected(numbers))), (r, expected(numbers))
            assert same(r.greatest, expected(numbers)[2])


def test_ranks_of_nothing(spark):
    df = spark.createDataFrame([], "k string, x double, n long, row long")
    assert at_ranks(df, ["k"], "x", ranks(), 0).collect() == []
