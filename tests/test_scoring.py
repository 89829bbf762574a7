import random

import pytest

from tablewarden.plans.scoring import likelihood_counts
from tablewarden.plans.split import split_tables

INF = float("inf")


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("limit", [1000, 1])
@pytest.mark.parametrize("larger", [False, True])
def test_counts_equal_a_comparison_with_every_row(spark, limit, larger):
    rng = random.Random(11)

    def theta():
        return rng.choice([0.0, -0.0, 0.25, 0.5, 0.75, 1.0, 2.0, 3.5, INF, -INF])

    model = list(
        {(rng.choice("fg"), theta(), theta()): None for _ in range(60)}
    )
    model = [(*m, rng.randint(1, 4)) for m in model]
    cands = [(rng.choice("fgh"), theta(), theta()) for _ in range(40)]
    found = likelihood_counts(
        table(spark, cands, "k string, t1 double, t2 double"),
        table(spark, model, "k string, t1 double, t2 double, w long"),
        ["k"],
        ("t1", "t2"),
        larger_is_extreme=larger,
        limit=limit,
    )

    def at_most(a, b):
        return a >= b if larger else a <= b

    expected = {
        (k, a + 0.0, b + 0.0): (
            sum(w for f, x, y, w in model if f == k and at_most(x, b)),
            sum(w for f, x, y, w in model if f == k and at_most(x, a) and at_most(b, y)),
        )
        for k, a, b in cands
    }
    got = {(r.k, r.t1, r.t2): (r.p_dt, r.p_dot) for r in found.collect()}
    assert got == expected


def test_split_is_exact_and_stable(spark):
    tables = spark.createDataFrame([(f"t{i}",) for i in range(37)], "table_id string")
    for share, n in ((0.8, 29), (0.0, 0), (1.0, 37)):
        found = {r.table_id: r.split for r in split_tables(tables, share, 5).collect()}
        assert sum(s == "train" for s in found.values()) == n
    again = {r.table_id: r.split for r in split_tables(tables.orderBy("table_id"), 1.0, 5).collect()}
    assert again == found
    with pytest.raises(ValueError):
        split_tables(tables, 1.5)
