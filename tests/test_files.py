from datetime import date, datetime
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablewarden.plans.measures import Measured
from tablewarden.sources import sinks
from tablewarden.sources.files import aggregate_lake, first_tables, list_tables, scan_lake

CSV = 'name,price,count,note\n"Smith, J",1.50,1,"say ""hi"""\nDoe,1e7,2,NA\nRoe,-0.0,,x\n'


def cells_of(lake):
    return {
        r.table_id.rsplit("/", 1)[-1]: None for r in lake.rows.select("table_id").distinct().collect()
    }, sorted((r.row_idx, list(r.cells)) for r in lake.rows.collect())


EXPECTED = [
    (0, ["Smith, J", "1.5", "1.0", 'say "hi"']),
    (1, ["Doe", "10000000.0", "2.0", None]),
    (2, ["Roe", "0.0", None, "x"]),
]
KINDS = ["object", "float64", "float64", "object"]


@pytest.mark.parametrize("small_file_bytes", [10_000, 1])
def test_csv_small_and_large(spark, tmp_path, small_file_bytes):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text(CSV)
    (tmp_path / "b.txt").write_text("no table")
    scan = scan_lake(spark, str(tmp_path), "csv", small_file_bytes)
    names, rows = cells_of(scan.lake)
    assert list(names) == ["a.csv"] and rows == EXPECTED
    meta = scan.lake.columns.orderBy("col_idx").collect()
    assert [r.col_name for r in meta] == ["name", "price", "count", "note"]
    assert [r.base_type for r in meta] == KINDS
    assert scan.rejected.count() == 0


def test_csv_forms(spark, tmp_path, monkeypatch):
    """Quoted line breaks, headers, ragged rows, big numbers and long fields, in small splits as well."""
    long = "x" * 20_000 + '""' * 3_000
    texts = {
        "breaks": 'a,b\n"one\n\ntwo",1\n\n3,"4 ""q"""\n',
        "names": "a,a,\n1,2,3\n",
        "short": "a,b\n1\n2,3\n",
        "wide": "a,b\n1,2,3\n",
        "open": 'a,b\n1,"2\n3,4\n',
        "big": "n\n9223372036854775808\n12\n",
        "long": f'a,b\n"{long}",1\n',
        "crlf": "a,b\r\n1,x\r\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    expected = {
        "breaks": [["one\n\ntwo", "1"], ["3", '4 "q"']],
        "names": [["1", "2", "3"]],
        "short": [["1", None], ["2", "3.0"]],
        "big": [["9223372036854775808"], ["12"]],
        "long": [["x" * 20_000 + '"' * 3_000, "1"]],
        "crlf": [["1", "x"]],
    }
    for size in ("128m", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            scan = scan_lake(spark, str(tmp_path))
            found = {}
            for r in scan.lake.rows.orderBy("row_idx").collect():
                found.setdefault(r.table_id.rsplit("/", 1)[-1][:-4], []).append(list(r.cells))
            rejected = {r.path.rsplit("/", 1)[-1][:-4] for r in scan.rejected.collect()}
            names = scan.lake.columns.filter("table_id LIKE '%names.csv'").orderBy("col_idx").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert found == expected and rejected == {"wide", "open"}
        assert [r.col_name for r in names] == ["a", "a.1", "Unnamed: 2"]


def test_broken_files_are_reported(spark, tmp_path):
    (tmp_path / "good.csv").write_text(CSV)
    (tmp_path / "bad.csv").write_text("\n")
    scan = scan_lake(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[-1] for r in scan.rejected.collect()] == ["bad.csv"]
    assert scan.lake.rows.count() == 3
    listed = list_tables(spark, str(tmp_path))
    assert listed.count() == 2 and first_tables(listed, 1).first().path.endswith("bad.csv")


FORMS = {
    "s": pa.array(["a", None, "é b"]),
    "x": pa.array([1e7, float("nan"), -0.0]),
    "tiny": pa.array([1e-5, 1e16, 123456.789]),
    "single": pa.array([0.1, None, 1e16], pa.float32()),
    "b": pa.array([True, None, False]),
    "n": pa.array([3, None, -(2**63)], pa.int64()),
    "small": pa.array([1, None, 255], pa.uint8()),
    "wide": pa.array([1, None, 2**40], pa.uint64()),
    "d": pa.array([Decimal("1.50"), None, Decimal("-0.00")], pa.decimal128(9, 2)),
    "day": pa.array([date(2020, 2, 29), None, date(1969, 1, 1)]),
    "at": pa.array([datetime(2020, 1, 2, 3, 4, 5), None, datetime(2021, 7, 1, 0, 0, 0, 120_000)], pa.timestamp("us", "UTC")),
    "local": pa.array([datetime(2020, 1, 2, 3, 4, 5), None, datetime(1999, 12, 31, 23, 59, 59, 1_000)], pa.timestamp("ms")),
    "list": pa.array([[1, 2], None, []], pa.list_(pa.int32())),
    "floats": pa.array([[0.1, None], [1e7], None], pa.list_(pa.float32())),
    "part": pa.array([{"p": 1, "q": "x"}, None, {"p": None, "q": 'say "é"'}]),
    "bytes": pa.array([b"ab", None, b"\xff"]),
    "kind": pa.array(["k", None, "k"]).dictionary_encode(),
    "a.b`c": pa.array([1, 2, 3]),
}


@pytest.mark.parametrize("small_file_bytes", [100_000, 1])
def test_parquet_small_and_large(spark, tmp_path, small_file_bytes):
    """Every form of value, in both ways of reading, and files that neither reads."""
    pq.write_table(pa.table(FORMS), tmp_path / "t.parquet")
    pq.write_table(pa.table({"a": [1], "b": ["x"]}), tmp_path / "u.parquet")
    pq.write_table(pa.table({"a": [2, 3], "b": ["y", "z"]}), tmp_path / "v.parquet")
    pq.write_table(pa.table([[1], [2]], names=["a", "A"]), tmp_path / "twice.parquet")
    pq.write_table(pa.table({"t": pa.array([1], pa.timestamp("ns"))}), tmp_path / "nanos.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no table PAR1")
    scan = scan_lake(spark, str(tmp_path), "parquet", small_file_bytes)
    found = {}
    for r in scan.lake.rows.orderBy("row_idx").collect():
        found.setdefault(r.table_id.rsplit("/", 1)[-1], []).append(list(r.cells))
    assert found.pop("u.parquet") == [["1", "x"]] and found.pop("v.parquet") == [["2", "y"], ["3", "z"]]
    texts = dict(zip(FORMS, zip(*found.pop("t.parquet"), strict=True), strict=True))
    assert not found
    assert texts == {
        "s": ("a", None, "é b"),
        "x": ("10000000.0", None, "0.0"),
        "tiny": ("1e-05", "1e+16", "123456.789"),
        "single": ("0.1", None, "1e+16"),
        "b": ("True", None, "False"),
        "n": ("3", None, "-9223372036854775808"),
        "small": ("1", None, "255"),
        "wide": ("1.0", None, "1099511627776.0"),
        "d": ("1.5", None, "0.0"),
        "day": ("2020-02-29", None, "1969-01-01"),
        "at": ("2020-01-02 03:04:05", None, "2021-07-01 00:00:00.12"),
        "local": ("2020-01-02 03:04:05", None, "1999-12-31 23:59:59.001"),
        "list": ("[1,2]", None, "[]"),
        "floats": ("[0.1,null]", "[10000000.0]", None),
        "part": ('{"p":1,"q":"x"}', None, '{"p":null,"q":"say \\"é\\""}'),
        "bytes": ("ab", None, "\ufffd"),
        "kind": ("k", None, "k"),
        "a.b`c": ("1", "2", "3"),
    }
    columns = scan.lake.columns.filter("table_id LIKE '%/t.parquet'").orderBy("col_idx").collect()
    assert [r.col_name for r in columns] == list(FORMS)
    assert [r.base_type for r in columns] == [
        "object", "float64", "float64", "float64", "bool", "int64", "int64", "float64", "float64",
        *["object"] * 8, "int64",
    ]
    rejected = {r.path.rsplit("/", 1)[-1] for r in scan.rejected.collect()}
    assert rejected == {"twice.parquet", "nanos.parquet", "broken.parquet"}


def test_aggregated_lake_and_truth(spark, tmp_path):
    from tablewarden.plans import detect, learn

    for name, dirty in (("beta", "x\na\na\nb\n"), ("alpha", "x\np\nq\nq\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "dirty.csv").write_text(dirty)
        (tmp_path / name / "clean.csv").write_text(dirty.replace("a\na", "c\na"))
    lakes = aggregate_lake(spark, str(tmp_path))
    names = {r.table_name: r.table_id for r in lakes.names.collect()}
    assert names == {"alpha": "0", "beta": "1"}
    uv = Measured(lakes.dirty).uv()
    findings = detect.detect_uv(uv, learn.uv_model(uv), lakes.dirty, lakes.clean)
    found = {r.path: (r.row_idx, r.value, r.correct_value, r.error, r.LR) for r in findings.collect()}
    assert found == {"0": (1, "q", "q", False, 1.0), "1": (0, "a", "c", True, 1.0)}


def test_sinks(spark, tmp_path):
    findings = spark.createDataFrame([("t1", "a", 0.5), ("t2", "b", None)], "table_id string, v string, LR double")
    sinks.write_by_table(findings, f"{tmp_path}/by_table", 8)
    assert [r.v for r in sinks.read_table(spark, f"{tmp_path}/by_table", "t2", 8).collect()] == ["b"]
    sinks.write_findings(findings, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2
    tokens = spark.range(25).select(F.col("id").cast("string").alias("token"), F.lit(1).alias("cnt")).coalesce(1)
    sinks.write_tokens(tokens, f"{tmp_path}/tokens", per_file=10)
    assert len(list((tmp_path / "tokens").glob("*.parquet"))) == 3
    assert sinks.read_tokens(spark, f"{tmp_path}/tokens").count() == 25
    sinks.write_model(findings, f"{tmp_path}/model")
    assert sinks.read_model(spark, f"{tmp_path}/model").count() == 2


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path):
    """Files cost their opening: few bytes in many files are no work for one task."""
    from tablewarden.registry_files import write_csv

    rows = spark.range(1_000).select(F.col("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    root = str(tmp_path / "csv")
    write_csv(rows, root, [F.expr("id div 2"), F.expr("id div 4 % 2")], [-F.col("id")], ["id", "t"])
    files = list((tmp_path / "csv").glob("*/*/*.csv"))
    assert len(files) == 500
    assert len({f.name.split("-")[1] for f in files}) >= 4
    for f in files:
        k = int(f.parent.parent.name.removeprefix("_part_0="))
        assert f.read_text().split() == f"id,t {2 * k + 1},text {2 * k + 1} {2 * k},text {2 * k}".split()


ODD_TEXTS = ['say "hi"', "a,b", "two\nlines", "cr\rhere", " led", "trail ", "", None, "\\", "#x", "é 😀", '"', "-", "\t"]


def test_tasks_write_the_files_that_sparks_writer_writes(spark, tmp_path, monkeypatch):
    from tablewarden import registry_files

    rows = [(k % 3 or None, f"f={k % 2}/x", k, text, float(k)) for k, text in enumerate(ODD_TEXTS * 2)]
    df = spark.createDataFrame(rows, "one int, `two d` string, k int, `the,text` string, x double").repartition(5)

    def written(name):
        write = (df, str(tmp_path / name), [F.col("one"), F.col("`two d`")], [-F.col("k")], ["the,text", "k", "x"])
        registry_files.write_csv(*write)
        registry_files.write_csv(write[0].limit(0), str(tmp_path / f"{name}-none"), *write[2:])
        assert scan_lake(spark, str(tmp_path / f"{name}-none")).lake.rows.isEmpty()
        files = [f for f in (tmp_path / name).rglob("*.csv") if not f.name.startswith(".")]
        return {str(f.parent.relative_to(tmp_path / name)): f.read_bytes() for f in files}

    by_tasks = written("tasks")
    monkeypatch.setattr(registry_files, "is_local", lambda *_: False)
    assert by_tasks == written("spark") and len(by_tasks) == 6


def test_whole_files_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Files that lie in one split are parsed where they are read, cut ones by their lines; records go on over batches."""
    from tablewarden.sources import files

    body = "".join(f'{k},"x\n""{k}"" ,\n\n",{k}.50\n\n' for k in range(40))
    for k in range(2):
        (tmp_path / f"{k}.csv").write_text("n,t,x\n" + body)
    (tmp_path / "plain.csv").write_text("n,n,\n" + "".join(f"{k},,{k}\n" for k in range(60)))
    (tmp_path / "open.csv").write_text("a\n1\n" + '"2\n' * 21)
    (tmp_path / "wide.csv").write_text("a\n" + "1\n" * 90 + "1,2\n")
    (tmp_path / "lines.csv").write_text("\n\n\n")

    def scanned():
        scan = scan_lake(spark, str(tmp_path))
        rows = sorted((r.table_id.rsplit("/", 1)[-1], r.row_idx, list(r.cells)) for r in scan.lake.rows.collect())
        return rows, sorted(tuple(r)[1:] for r in scan.lake.columns.collect()), sorted((r.path[-8:], r.error) for r in scan.rejected.collect())

    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    try:
        cut = scanned()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(files, "_scan_cut", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        whole = scanned()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == cut and len(cut[0]) == 2 * 40 + 60
    assert cut[0][1] == ("0.csv", 1, ["1", 'x\n"1" ,\n\n', "1.5"])
    assert [error for _, error in cut[2]] == ["no columns", "a quote is not closed", "a row is longer than the header"]
