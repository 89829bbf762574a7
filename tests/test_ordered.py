import os
import random

from pyspark.sql import functions as F

from tablewarden.operators.joins import attach, with_group_totals
from tablewarden.operators.ordered import number_rows, running_sums


def sample(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aaaaab"), i * 7 % 101, rng.randrange(5)) for i in range(101)]
    return spark.createDataFrame(rows, "k string, o long, w long").repartition(5), rows


def expected_sums(rows):
    return sorted((k, o, w, sum(x[2] for x in rows if x[0] == k and x[1] <= o)) for k, o, w in rows)


def test_running_sums_by_window_and_by_ranges(spark):
    df, rows = sample(spark)
    for limit in (1000, 1):
        found = running_sums(df, ["k"], [F.col("o")], {"s": F.col("w")}, 80, limit)
        assert sorted(map(tuple, found.collect())) == expected_sums(rows)


def test_number_rows_without_keys(spark):
    df, rows = sample(spark)
    for limit in (1000, 1):
        found = number_rows(df, [], [F.col("o")], largest=101, limit=limit)
        assert [r.o for r in found.orderBy("row_idx").collect()] == sorted(r[1] for r in rows)
        assert found.agg(F.max("row_idx")).first()[0] == 100


def test_attach_ways_agree(spark):
    big = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 0), ("c", 0)], "k string, p long")
    small = spark.createDataFrame([("a", 20, 1), ("b", 1, 2)], "k string, n long, v int")
    for how in ("inner", "left_anti"):
        ways = [
            attach(big, small, ["k"], F.col("p"), "n", 20, limit, broadcast, 3, how)
            for limit, broadcast in ((100, 100), (0, 100), (0, 0))
        ]
        found = [sorted(map(tuple, w.collect())) for w in ways]
        assert found[0] == found[1] == found[2]
        assert len(found[0]) == (21 if how == "inner" else 1)


def test_group_totals(spark, wide):
    df, rows = sample(spark)
    found = with_group_totals(df, ["k"], {"t": F.sum("w")}, F.col("o"), 80)
    totals = {k: sum(r[2] for r in rows if r[0] == k) for k in "ab"}
    assert found.count() == 101
    assert all(r.t == totals[r.k] for r in found.collect())


def test_owned_stages_are_deleted(spark):
    from tablewarden.session import owned_stages, stage

    kept = stage(spark.range(3), "kept")
    with owned_stages(spark):
        outer = stage(spark.range(5), "outer")
        with owned_stages(spark):
            inner = stage(spark.range(7), "inner")
            assert inner.count() == 7
        folders = [os.path.dirname(df.inputFiles()[0][len("file:") :].replace("//", "/")) for df in (outer, inner)]
        assert outer.count() == 5 and [os.path.isdir(f) for f in folders] == [True, False]
    assert kept.count() == 3 and not os.path.isdir(folders[0])
