"""Contradicted determinant values of whole tables, against the definition; what a lake's cut shuffles."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import contradictions as module
from tablewarden.plans import detect
from tablewarden.plans.detect import lookup_rows
from tablewarden.sources.lake import lake_from_table


def tables(seed):
    draw = random.Random(seed)
    return {
        f"t{k}": [
            [draw.choice([None, 0, 1, 2, 2**62 + k]) for _ in range(1 + k % 4)] for _ in range(draw.randint(1, 30))
        ]
        for k in range(20)
    }


def by_definition(made):
    found = {}
    for name, rows in made.items():
        width = len(rows[0])
        for one in range(width):
            for two in range(one + 1, width):
                groups = {}
                for at, cells in enumerate(rows):
                    if cells[one] is not None:
                        groups.setdefault(cells[one], []).append((at, cells[two]))
                codes = []
                for group in groups.values():
                    differ = [at for at, b in group[1:] if b is None or b != group[0][1]]
                    if differ:
                        codes.append(2 * differ[0] + (len(differ) == 1))
                if codes:
                    found[name, one, two] = len(codes), min(codes)
    return found


@pytest.mark.parametrize("chunk, batch, mix", [(8, 5, True), (1000, 7, True), (8, 64, False)])
def test_contradictions(monkeypatch, chunk, batch, mix):
    monkeypatch.setattr(module, "CHUNK_ROWS", chunk)
    if not mix:  # every group has the same number
        monkeypatch.setattr(module, "MIX", module.MIX * 0)
    made = tables(chunk)
    rows = [(name, at, cells) for name, table in made.items() for at, cells in reversed(list(enumerate(table)))]
    lists = pa.array([cells for _, _, cells in rows], pa.list_(pa.int64()))
    whole = pa.table(
        {"table_id": [r[0] for r in rows], "row_idx": pa.array([r[1] for r in rows], pa.int64()), "x": lists, "y": lists}
    )
    out = [r for b in module.contradictions(iter(whole.to_batches(batch))) for r in b.to_pylist()]
    got = {(r["table_id"], r["col_1_idx"], r["col_2_idx"]): (r["violated"], r["code"]) for r in out}
    assert len(out) == len(got) and got == by_definition(made)


def test_cut_and_lookup(spark):
    """Order columns are shuffled once, and only the tables with a candidate are numbered again."""
    df = spark.createDataFrame([(k % 5, 9 - k, f"v{k}") for k in range(10)], "k int, o int, v string")
    lake = lake_from_table(df, "k", ["o"], ["o", "v"])
    assert "_order_" not in lake.rows._jdf.queryExecution().optimizedPlan().toString()
    candidates = spark.createDataFrame([("1", 1)], "table_id string, suspect_row long")
    found = lookup_rows(lake, candidates)
    assert [tuple(r) for r in found.select("table_id", "row_idx", F.col("cells")[1]).collect()] == [("1", 1, "v1")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [") :]
    assert "Join LeftSemi" in below


def test_lookup_of_many_rows_shuffles_no_texts(spark, monkeypatch):
    """Beyond the broadcast, tables meet their suspect rows by the key they are numbered by."""
    monkeypatch.setattr(detect, "LOOKUP_ROWS", 0)
    df = spark.createDataFrame([(k % 5, 9 - k, f"v{k}") for k in range(10)], "k int, o int, v string")
    lake = lake_from_table(df, "k", ["o"], ["o", "v"])
    candidates = spark.createDataFrame([("1", 1), ("1", 1), ("3", 0), ("none", 0)], "table_id string, suspect_row long")
    found = lookup_rows(lake, candidates)
    rows = sorted(tuple(r) for r in found.select("table_id", "row_idx", F.col("cells")[1]).collect())
    assert rows == [("1", 1, "v1"), ("3", 0, "v8")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_contains") < plan.index("Window [") and "LeftSemi, ((table_id" not in plan
    assert "cells" in plan.split("Window [")[0] and "AS cells" not in plan.split("Window [")[1]
