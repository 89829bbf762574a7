"""Stores that grow: batches, pruned reads, runs that are not shuffled again, footers read by tasks."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewarden.functions.text import file_stem
from tablewarden.operators.tokens import cell_tokens, table_tokens
from tablewarden.operators.values import value_dictionary
from tablewarden.plans import learn
from tablewarden.sources import files, store
from tests import brute

FIELDS = "table_id string, d_type string, rows_range int, left_ness int, avg_col_pre int, ur double, ur_p double"


def measures(spark, tables):
    return spark.createDataFrame([(t, "object", 0, c, 1, u, 1.0) for t, c, u in tables], FIELDS)


def model_rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_learning_in_parts(spark, tmp_path):
    rows = [(f"t{k}", k % 3, [0.5, 0.75][k % 2]) for k in range(40)]
    path = f"{tmp_path}/training"
    store.learn_tables(measures(spark, rows[:15]), path, "uv", learn.uv_model)
    # Known tables are left alone, even where they measure differently now.
    store.learn_tables(measures(spark, [(t, c, 0.1) for t, c, _ in rows[:15]] + rows[15:30]), path, "uv", learn.uv_model)
    store.learn_tables(measures(spark, rows), path, "uv", learn.uv_model)
    store.learn_tables(measures(spark, rows), path, "uv", learn.uv_model)
    assert spark.read.parquet(f"{path}/ledger/uv").select("batch").distinct().count() == 3
    assert model_rows(store.stored_model(spark, path, "uv")) == model_rows(learn.uv_model(measures(spark, rows)))
    assert sorted(r.table_id for r in store.stored_measures(spark, path, "uv").collect()) == sorted(t for t, _, _ in rows)
    one = store.stored_measures(spark, path, "uv", "t7")
    assert [(r.table_id, r.left_ness) for r in one.collect()] == [("t7", 1)]
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(one)
    assert store.learnt_tables(spark, path, "se").count() == 0


def test_a_lost_run_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/training"
    store.learn_tables(measures(spark, [("a", 0, 0.5)]), path, "uv", learn.uv_model)

    def lost(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        store.learn_tables(measures(spark, [("b", 0, 0.5)]), path, "uv", lost)
    # Measures and counts of a run that was lost before the ledger are there, and not read.
    learn.uv_model(measures(spark, [("b", 0, 0.5)])).write.parquet(f"{path}/models/uv/batch=bdead")
    assert [r.table_id for r in store.stored_measures(spark, path, "uv").collect()] == ["a"]
    assert [r.w for r in store.stored_model(spark, path, "uv").collect()] == [1]
    store.learn_tables(measures(spark, [("b", 0, 0.5)]), path, "uv", learn.uv_model)
    assert [r.w for r in store.stored_model(spark, path, "uv").collect()] == [2]


def test_findings_by_table(spark, tmp_path):
    found = spark.createDataFrame([("t1", 3, "x"), ("t1", 4, "y"), ("t2", 0, "z")], "path string, row_idx long, value string")
    tables = spark.createDataFrame([("t1",), ("t2",), ("t3",), ("t3",)], "table_id string")
    rejected = spark.createDataFrame([("bad", "no columns")], "path string, error string")
    path = f"{tmp_path}/findings"
    store.write_findings_by_table(found, tables, path, rejected)
    record = {r.path: (r.n_findings, r.error) for r in store.searched_tables(spark, path).collect()}
    assert record == {"t1": (2, None), "t2": (1, None), "t3": (0, None), "bad": (0, "no columns")}
    one = store.findings_of_table(spark, path, "t1")
    assert sorted(r.value for r in one.collect()) == ["x", "y"] and one.columns == found.columns
    assert "PartitionFilters: [isnotnull(bucket" in plan_of(one)
    assert store.findings_of_table(spark, path, "t3").count() == 0
    store.write_findings_by_table(found.limit(0), tables, f"{path}-none")
    assert {r.n_findings for r in store.searched_tables(spark, f"{path}-none").collect()} == {0}


def test_token_runs_are_merged_where_they_lie(spark, tmp_path):
    old = {f"w{k}": k + 1 for k in range(300)}
    new = {f"w{k}": 1000 * k for k in range(250, 400)}
    path = f"{tmp_path}/runs"
    store.write_token_runs(spark.createDataFrame(list(old.items()), "token string, cnt long"), path, 8)
    merged = store.merge_token_runs(spark, path, spark.createDataFrame(list(new.items()), "token string, cnt long"), 8)
    plan = plan_of(merged)
    expected = {k: old.get(k, 0) + new.get(k, 0) for k in old | new}
    assert {r.token: r.cnt for r in merged.collect()} == expected
    # One side is read by bucket without an exchange, the other is dealt into the same buckets.
    assert plan.index("Bucketed: true") < plan.index("Exchange") and plan.count("hashpartitioning(token") == 2
    again = f"{tmp_path}/again"
    store.write_token_runs(merged, again, 8)
    assert {r.token: r.cnt for r in store.read_token_runs(spark, again, 8).collect()} == expected
    assert len(list((tmp_path / "again").glob("*.parquet"))) <= 8


def test_untyped_texts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1.50,"two words\n  here"\n,NA\n007,e e\n')
    plain = files.scan_lake(spark, str(tmp_path), typed=False).lake
    assert sorted(map(tuple, (r.cells for r in plain.rows.collect())), key=str) == sorted(
        [("1.50", "two words\n  here"), (None, None), ("007", "e e")], key=str
    )
    assert {r.base_type for r in plain.columns.collect()} == {"object"}
    direct = {r.token: r.cnt for r in cell_tokens(plain.rows).collect()}
    assert direct == {"1.50": 1, "two": 1, "words": 1, "here": 1, "nan": 2, "007": 1, "e": 2}
    assert direct == {r.token: r.cnt for r in table_tokens(value_dictionary(plain)).collect()}


def test_footers_are_read_by_tasks(spark, tmp_path, monkeypatch):
    for k in range(6):
        pq.write_table(pa.table({"a": [k], "b": ["x"]} if k % 2 else {"a": [float(k)]}), tmp_path / f"t{k}.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table PAR1")
    asked = []
    ask = files._spark_schema
    monkeypatch.setattr(files, "_spark_schema", lambda session, path: asked.append(file_name(path)) or ask(session, path))
    scan = files.scan_lake(spark, [str(tmp_path)], "parquet", 0)
    rows = {(r.table, tuple(r.cells)) for r in scan.lake.rows.withColumn("table", file_stem(F.col("table_id"))).collect()}
    assert rows == {(f"t{k}", (str(k), "x") if k % 2 else (f"{k}.0",)) for k in range(6)}
    assert sorted(asked) == ["broken.parquet", "t0.parquet", "t1.parquet"]  # one of each schema, and what no task could read
    assert [file_name(r.path) for r in scan.rejected.collect()] == ["broken.parquet"]
    # Behind a path that tasks cannot open, the driver is asked for all.
    monkeypatch.setattr(files, "_footers", lambda batches: (pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.string())], ["path", "key"]) for b in batches))
    again = files.scan_lake(spark, str(tmp_path), "parquet", 0)
    assert again.lake.rows.count() == 6 and again.lake.columns.count() == 9 and again.rejected.count() == 1


def file_name(path):
    return path.rsplit("/", 1)[-1]


def test_dependencies_with_gaps_and_ties(spark):
    """Both ways over random small tables with missing cells, against the definition."""
    import random

    from tablewarden.operators import ordered
    from tablewarden.plans.measures import Measured

    rng = random.Random(11)
    tables = {
        f"t{k}": [[rng.choice(["a", "b", None, "c"][: rng.randrange(1, 5)]) for _ in range(n)] for _ in range(rng.randrange(1, 6))]
        for k, n in enumerate([1, 2, 3, 4, 5, 8, 13] * 6)
    }
    limit = ordered.GROUP_LIMIT
    for wide in (False, True):
        ordered.GROUP_LIMIT = 0 if wide else limit
        try:
            found = Measured(brute.make_lake(spark, tables)).fd().collect()
        finally:
            ordered.GROUP_LIMIT = limit
        assert len(found) == sum(len(c) * (len(c) - 1) // 2 for c in tables.values())
        for r in found:
            x, y = tables[r.table_id][r.col_1_idx], tables[r.table_id][r.col_2_idx]
            if any(v is not None for v in x):
                fd, fd_p, suspect = brute.compliance(x, y)
                assert (r.fd, r.suspect_row) == (pytest.approx(fd), suspect)
                assert suspect is None or r.fd_p == pytest.approx(fd_p) or len([v for v in x if v is not None]) == 1
