"""Lakes of CSV and Parquet files.

A CSV file of any size is read in splits, by line; lines whose quotes are open at their end are put
together with the next ones. A file that lies in one split is parsed where it is read, and only lines
of files that were cut are shuffled. Parquet files are mostly small, with a schema each, which no single
reader schema fits: small ones are parsed one by one inside tasks, large ones read in splits by one
reader for each schema. Both ways give equal texts, types and rejects.
"""

from __future__ import annotations

import csv
import hashlib
import io
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewarden.functions.arrow_text import arrow_kind, arrow_texts, column_text
from tablewarden.functions.text import base_type, cell_text, float_text, number, quoted
from tablewarden.operators.joins import BROADCAST_BYTES, attach, json_bytes
from tablewarden.operators.ordered import largest_group, number_rows, running_sums
from tablewarden.operators.types import column_types
from tablewarden.session import ship_package, stage
from tablewarden.sources.lake import Lake, union_lakes

SMALL_FILE_BYTES = 8 * 1024 * 1024

# The texts that CSV reading takes for a missing cell.
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

PARSED_SCHEMA = (
    "kind string, table_id string, row_idx long, cells array<string>, "
    "col_idx int, col_name string, base_type string, error string"
)


# Whole files as they are parsed: records, then a row of n, width, widest and open for each file; lines of the others.
SPLIT_SCHEMA = (
    "table_id string, _file long, row_idx long, cells array<string>, width int, "
    "n long, widest int, open boolean, _block_start long, _at long, line string"
)
# Numbers of files that may be broadcast with short texts each, if the bytes are few as well.
BROADCAST_FILES = 500_000
# Bytes that a file counts for beside its own where files are shared out to tasks.
OPENING_BYTES = 1 << 20
# Tasks for each core that list folders.
LISTING_TASKS = 32


# Errors of files that are no Parquet files or have types that are not read.
UNREADABLE = ("CANNOT_READ_FILE_FOOTER", "PARQUET_TYPE_ILLEGAL", "PARQUET_TYPE_NOT_SUPPORTED", "Illegal Parquet type")


@dataclass(frozen=True)
class Scan:
    """A lake read from files, and the files that could not be read."""

    lake: Lake
    rejected: DataFrame


# A folder, or the paths of single files and folders.
Root = str | list[str]


def list_tables(spark: SparkSession, root: Root, file_type: str = "csv") -> DataFrame:
    """(path, length) of all files under `root` with the given suffix, but for files of no bytes.

    Contents are not read.
    """
    return _binary(spark, root, file_type).select(F.col("_metadata.file_path").alias("path"), "length")


def _binary(spark: SparkSession, root: Root, file_type: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{file_type}")
        .load(root)
    )


def first_tables(tables: DataFrame, n: int) -> DataFrame:
    """The first n files by path."""
    return tables.orderBy("path").limit(n)


# ---- small Parquet files ---------------------------------------------------------------------------------


def _parse_files(zone: str, rows_at_once: int = 4096):
    """Rows and columns of whole Parquet files, with the types that Spark gives them.

    Names repeated but for case, and types that Spark cannot read, make a file one to reject, as
    they do where Spark reads it.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    file = pq.ParquetFile(pa.BufferReader(content))
                    fields = list(file.schema_arrow)
                    if len({f.name.lower() for f in fields}) < len(fields):
                        raise ValueError("a column name is repeated")
                    kinds = [arrow_kind(f.type) for f in fields]
                    found = [_parsed(path, "column", len(fields), {
                        "col_idx": pa.array(range(len(fields)), pa.int32()),
                        "col_name": pa.array([f.name for f in fields], pa.string()),
                        "base_type": pa.array(kinds, pa.string()),
                    })]
                    start = 0
                    for part in file.iter_batches(rows_at_once):
                        cells = _rows_of([arrow_texts(c, zone) for c in part.columns], part.num_rows)
                        numbers = pa.array(range(start, start + part.num_rows), pa.int64())
                        found.append(_parsed(path, "row", part.num_rows, {"row_idx": numbers, "cells": cells}))
                        start += part.num_rows
                except Exception as problem:  # any broken file is reported, none stops the scan
                    error = pa.array([f"{type(problem).__name__}: {problem}"])
                    found = [_parsed(path, "error", 1, {"error": error})]
                yield from found

    return parse


def _rows_of(columns: list[pa.Array], n: int) -> pa.ListArray:
    """A list of cells per row, from the columns' texts."""
    width = len(columns)
    order = np.arange(n * width).reshape(width, n).T.reshape(-1)
    flat = pa.concat_arrays(columns).take(pa.array(order)) if width else pa.array([], pa.string())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)


def _parsed(path: str, kind: str, n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
    types = {"row_idx": pa.int64(), "cells": pa.list_(pa.string()), "col_idx": pa.int32(),
             "col_name": pa.string(), "base_type": pa.string(), "error": pa.string()}
    rest = [given[name] if name in given else pa.nulls(n, kind_) for name, kind_ in types.items()]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array([path] * n, pa.string()), *rest], ["kind", "table_id", *types]
    )


def _scan_small(spark: SparkSession, root: Root, limit: int) -> Scan:
    files = _binary(spark, root, "parquet").filter(F.col("length") <= limit)
    files = files.select(F.col("_metadata.file_path").alias("path"), "content")
    zone = spark.conf.get("spark.sql.session.timeZone")
    parsed = stage(files.mapInArrow(_parse_files(zone), PARSED_SCHEMA), "parsed")
    return Scan(
        Lake(
            parsed.filter("kind = 'row'").select("table_id", "row_idx", "cells"),
            parsed.filter("kind = 'column'").select("table_id", "col_idx", "col_name", "base_type"),
        ),
        parsed.filter("kind = 'error'").select(F.col("table_id").alias("path"), "error"),
    )


# ---- CSV files -----------------------------------------------------------------------------------


def _column_names(header: list[str]) -> list[str]:
    """Names of the columns: empty ones are called by their place, repeated ones are numbered."""
    seen: dict[str, int] = {}
    names = []
    for i, name in enumerate(header):
        name = name or f"Unnamed: {i}"
        times = seen.get(name, 0)
        seen[name] = times + 1
        names.append(f"{name}.{times}" if times else name)
    return names


def _cells_of(record: str) -> list[str]:
    """Cells of a record, unquoted."""
    if '"' not in record and "\r" not in record:
        return record.split(",")
    return next(csv.reader(io.StringIO(record, newline="")), [])


def _parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of each record; the first record of a table gives the column names."""
    csv.field_size_limit(2**31 - 1)
    for batch in batches:
        rows = []
        for number, record in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            cells = _cells_of(record)
            rows.append(_column_names(cells) if number == 0 else cells)
        cells = pa.array(rows, pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), cells], ["table_id", "row_idx", "cells"])


@dataclass
class _File:
    """A whole file that a task is reading, line by line."""

    path: str
    number: int
    n: int = 0
    width: int | None = None
    widest: int | None = None
    held: list[str] | None = None

    def records(self, lines: pa.Array) -> pa.ListArray:
        """Cells of the records that end in these lines."""
        quotes = np.asarray(pc.count_substring(lines, '"'))
        if self.held is None and not quotes.any() and not pc.any(pc.match_substring(lines, "\r")).as_py():
            cells = pc.split_pattern(lines.filter(pc.not_equal(lines, "")), ",")
        else:
            texts = []
            for line, odd in zip(lines.to_pylist(), (quotes % 2).tolist(), strict=True):
                if self.held is not None:
                    self.held.append(line)
                elif odd:
                    self.held = [line]
                elif line:
                    texts.append(line)
                if odd and len(self.held) > 1:
                    texts.append("\n".join(self.held))
                    self.held = None
            cells = pa.array([_cells_of(t) for t in texts], pa.list_(pa.string()))
        if self.n == 0 and len(cells):
            header = cells[0].as_py()
            names = _column_names(header)
            if names != header:
                cells = pa.concat_arrays([pa.array([names], cells.type), cells.slice(1)])
            self.width = self.widest = len(names)
        if len(cells):
            self.widest = max(self.widest, pc.max(pc.list_value_length(cells)).as_py())
        self.n += len(cells)
        return cells


def _filled(n: int, given: dict[str, pa.Array]) -> pa.RecordBatch:
    types = {"table_id": pa.string(), "_file": pa.int64(), "row_idx": pa.int64(), "cells": pa.list_(pa.string()),
             "width": pa.int32(), "n": pa.int64(), "widest": pa.int32(), "open": pa.bool_(),
             "_block_start": pa.int64(), "_at": pa.int64(), "line": pa.string()}
    return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, kind) for c, kind in types.items()], list(types))


def _closed(files: list[_File]) -> pa.RecordBatch:
    return _filled(len(files), {
        "table_id": pa.array([f.path for f in files], pa.string()),
        "_file": pa.array([f.number for f in files], pa.int64()),
        "width": pa.array([f.width for f in files], pa.int32()),
        "n": pa.array([f.n for f in files], pa.int64()),
        "widest": pa.array([f.widest for f in files], pa.int32()),
        "open": pa.array([f.held is not None for f in files], pa.bool_()),
    })


def _parse_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of the whole files of a partition, whose lines come in order, and lines of cut files as they are.

    A file is known by the number of its first line. What a task holds of a file is the lines of one
    batch and of a record that is not at its end.
    """
    csv.field_size_limit(2**31 - 1)
    now: _File | None = None
    for batch in batches:
        cut = batch.filter(pc.invert(batch.column("whole")))
        if cut.num_rows:
            yield _filled(cut.num_rows, {c: cut.column(c) for c in ("table_id", "_block_start", "_at", "line")})
            batch = batch.filter(batch.column("whole"))
        if not batch.num_rows:
            continue
        paths, numbers, lines = (batch.column(c) for c in ("table_id", "_at", "line"))
        changes = np.flatnonzero(np.asarray(pc.not_equal(paths.slice(1), paths.slice(0, len(paths) - 1)))) + 1
        read, done, starts, found = [], [], [], []
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(paths)], strict=True):
            path = paths[a].as_py()
            if now is None or now.path != path:
                done.extend([now] if now else [])
                now = _File(path, numbers[a].as_py())
            starts.append(now.n)
            found.append(now.records(lines.slice(a, b - a)))
            read.append(now)
        sizes = np.array([len(cells) for cells in found])
        n = int(sizes.sum())
        which = np.repeat(np.arange(len(read)), sizes)
        before = np.cumsum(sizes) - sizes
        if n:
            yield _filled(n, {
                "table_id": pa.array([f.path for f in read], pa.string()).take(pa.array(which)),
                "_file": pa.array(np.array([f.number for f in read])[which], pa.int64()),
                "row_idx": pa.array(np.arange(n) + (np.array(starts) - before)[which], pa.int64()),
                "cells": pa.concat_arrays(found),
                "width": pa.array([f.width for f in read], pa.int32()).take(pa.array(which)),
            })
        if done:
            yield _closed(done)
    if now is not None:
        yield _closed([now])


def _records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table_id, row_idx, record) of all lines, and table ids whose quotes do not close.

    A line begins a record if the quotes before it in its file are even in number.
    """
    order = [F.col("_block_start"), F.col("_at")]
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    largest = largest_group(lines, ["table_id"])
    counted = stage(
        running_sums(lines, ["table_id"], order, {"_quotes": quotes, "_line": F.lit(1).cast("long")}, largest).withColumn(
            "_begins", (F.col("_quotes") - quotes) % 2 == 0
        ),
        "lines",
    )
    ends = counted.groupBy("table_id").agg(F.max_by("_quotes", "_line").alias("_all"))
    unclosed = stage(ends.filter("_all % 2 = 1").select("table_id"), "unclosed")
    if not unclosed.isEmpty():
        counted = counted.join(unclosed, "table_id", "left_anti")
    counted = counted.filter(~F.col("_begins") | (F.col("line") != ""))
    one = F.when(F.col("_begins"), 1).otherwise(0).cast("long")
    numbered = running_sums(counted, ["table_id"], [F.col("_line")], {"_record": one}, largest)
    if counted.filter(~F.col("_begins")).isEmpty():
        records = numbered.withColumnRenamed("line", "record")
    else:
        parts = F.sort_array(F.collect_list(F.struct("_line", "line")))
        records = numbered.groupBy("table_id", "_record").agg(
            F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record")
        )
    return records.select("table_id", (F.col("_record") - 1).alias("row_idx"), "record"), unclosed


def _scan_cut(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records and shapes, as _parse_splits makes them, of files whose lines come from several splits."""
    records, unclosed = _records(lines)
    rows = stage(records.mapInArrow(_parse_records, "table_id string, row_idx long, cells array<string>"), "rows")
    found = rows.groupBy("table_id").agg(
        F.max(F.when(F.col("row_idx") == 0, F.size("cells"))).alias("width"),
        F.count(F.lit(1)).alias("n"),
        F.max(F.size("cells")).alias("widest"),
    )
    files = lines.groupBy("table_id").agg(F.min("_at").alias("_file"))
    shapes = files.join(found, "table_id", "left").join(unclosed.withColumn("open", F.lit(True)), "table_id", "left")
    fields = ["table_id", "_file", "width", F.coalesce("n", F.lit(0)).alias("n"), "widest", F.coalesce("open", F.lit(False)).alias("open")]
    shapes = stage(shapes.select(*fields), "shapes")
    largest = shapes.agg(F.max("n")).first()[0] or 0
    given = shapes.where("n > 0").select("table_id", "_file", "width", "n")
    placed = attach(rows, given, ["table_id"], F.col("row_idx"), "n", largest)
    return placed.select("table_id", "_file", "row_idx", "cells", "width"), shapes


def _with_files(rows: DataFrame, files: DataFrame, key: str, extent: str, largest: int, how: str = "inner") -> DataFrame:
    """`rows` joined with one row for each file or table, which is broadcast if all are few and short."""
    n, size = files.agg(F.count(F.lit(1)), json_bytes(files)).first()
    if n <= BROADCAST_FILES and (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(files.drop(extent)), key, how)
    return attach(rows, files, [key], F.col("row_idx"), extent, largest, how=how)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session with another setting inside the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def scan_csv(spark: SparkSession, root: Root, file_type: str = "csv", typed: bool = True) -> Scan:
    """CSV files of any size, read in splits, types inferred from the texts.

    With `typed=False` the texts stay as they are written, and all columns are object: no pass over
    the cells for types. Lines that are empty outside quotes are skipped, and missing cells at the end
    of a row are NULL. Rejected are files without any record, with a row longer than the header, or
    with an open quote.
    """
    ship_package(spark)
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{file_type}").option("lineSep", "\n")
    # Folders are listed when the reader is made, else by a task each up to 10,000.
    listing = str(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    with _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", listing):
        texts = reader.text(root)
    lines = texts.select(
        F.col("_metadata.file_path").alias("table_id"),
        F.expr("_metadata.file_block_start = 0 AND _metadata.file_block_length = _metadata.file_size").alias("whole"),
        F.col("_metadata.file_block_start").alias("_block_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    # Written once for every reader of the lake, so in few bytes.
    with _setting(spark, "spark.sql.files.openCostInBytes", str(OPENING_BYTES)):
        read = stage(lines.mapInArrow(_parse_splits, SPLIT_SCHEMA), "rows", "zstd")
    rows = read.where("row_idx IS NOT NULL").select("table_id", "_file", "row_idx", "cells", "width")
    shapes = stage(read.where("n IS NOT NULL").select("table_id", "_file", "width", "n", "widest", "open"), "shapes")
    cut = read.where("line IS NOT NULL").select("table_id", "_block_start", "_at", "line")
    if not cut.isEmpty():
        cut_rows, cut_shapes = _scan_cut(cut)
        rows, shapes = rows.union(cut_rows), shapes.union(cut_shapes)
    largest = shapes.agg(F.max("n")).first()[0] or 0
    bad = shapes.where("open OR widest > width")
    if not bad.isEmpty():
        rows = _with_files(rows, bad.select("_file", "n"), "_file", "n", largest, "left_anti")
    columns = rows.filter(F.col("row_idx") == 0).select(
        "table_id",
        "_file",
        F.posexplode("cells").alias("col_idx", "col_name"),
        F.lit("object").alias("base_type"),
    )
    known = F.transform("cells", lambda c: F.when(~c.isin(*MISSING_TEXTS), c))
    padded = F.concat(known, F.array_repeat(F.lit(None).cast("string"), F.col("width") - F.size("cells")))
    data = rows.filter("row_idx > 0").select("table_id", "_file", (F.col("row_idx") - 1).alias("row_idx"), padded.alias("cells"))
    rejected = shapes.where("open OR n = 0 OR widest > width").select(
        F.col("table_id").alias("path"),
        F.expr(
            "CASE WHEN open THEN 'a quote is not closed' WHEN n = 0 THEN 'no columns' ELSE 'a row is longer than the header' END"
        ).alias("error"),
    )
    lake = Lake(data, columns)
    return Scan(retyped(lake, "_file") if typed else Lake(data.drop("_file"), columns.drop("_file")), rejected)


# Types of columns as letters, so that those of a table are short texts.
TYPE_LETTERS = {"float64": "f", "int64": "i"}


def retyped(lake: Lake, key: str = "table_id") -> Lake:
    """The lake with types inferred from its texts and numbers in canonical form (`1.50` as `1.5`).

    `key` is the column of rows and columns that tells tables apart, a number rather than a path if there is one.
    """
    found = stage(column_types(lake.rows.select(F.col(key).alias("table_id"), "cells")), "types")
    columns = lake.columns.drop("base_type").join(found.withColumnRenamed("table_id", key), [key, "col_idx"])
    columns = stage(columns, "columns")
    letter = F.coalesce(*[F.when(F.col("base_type") == kind, F.lit(x)) for kind, x in TYPE_LETTERS.items()], F.lit("-"))
    tables = columns.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("col_idx", letter.alias("letter")))), lambda c: c["letter"]).alias("types"),
        F.max("n_rows").alias("n_rows"),
    )
    tables = stage(tables, "tables")
    largest = tables.agg(F.max("n_rows")).first()[0] or 0
    typed = _with_files(lake.rows, tables, key, "n_rows", largest)

    def render(cell: Column, kind: Column) -> Column:
        return (
            F.when(kind == TYPE_LETTERS["float64"], float_text(number(cell)))
            .when(kind == TYPE_LETTERS["int64"], F.coalesce(cell.try_cast("long").cast("string"), cell))
            .otherwise(cell)
        )

    return Lake(
        typed.select("table_id", "row_idx", F.zip_with("cells", "types", render).alias("cells")),
        columns.select("table_id", "col_idx", "col_name", "base_type"),
    )


def parquet_table(spark: SparkSession, path: str, table_id: str | None = None) -> Lake:
    """One Parquet file of any size as one table, rows in file order."""
    name = F.lit(table_id or path)
    return _one_schema(spark.read.parquet(path), name, spark.range(1).select(name.alias("table_id")))


def _one_schema(df: DataFrame, name: Column, tables: DataFrame) -> Lake:
    """Tables that share a schema, read by one reader; `tables` has their table_id."""
    spark = df.sparkSession
    zone = spark.conf.get("spark.sql.session.timeZone")
    # Types whose texts would depend on the version of Java or on Spark's options for JSON.
    by_arrow = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.FloatType)
    kinds = [(f.name, base_type(f.dataType)) for f in df.schema.fields]
    cells = F.array(*[
        column_text(quoted(f.name), zone) if isinstance(f.dataType, by_arrow) else cell_text(quoted(f.name), f.dataType)
        for f in df.schema.fields
    ])
    rows = df.select(name.alias("table_id"), F.col("_metadata.row_index").alias("row_idx"), cells.alias("cells"))
    described = F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(n).alias("col_name"), F.lit(kind).alias("base_type"))
        for i, (n, kind) in enumerate(kinds)
    ])
    return Lake(rows, tables.select("table_id", F.inline(described)))


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of each file's schema, from its last bytes alone; none where a task cannot open it."""
    for batch in batches:
        keys = []
        for path in batch.column(0).to_pylist():
            try:
                system, place = pa.fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as source:
                    footer = pq.ParquetFile(source).metadata
                    spark_schema = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata", b"")
                    columns = str(footer.schema).partition("\n")[2]  # the first line names the object
                    keys.append(hashlib.md5(columns.encode() + spark_schema).hexdigest())
            except (pa.ArrowException, OSError):  # Spark is asked, which says why or can open it
                keys.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], ["path", "key"])


def _spark_schema(spark: SparkSession, path: str) -> T.StructType | str:
    """The schema of a file as Spark reads it, or why it does not."""
    try:
        return spark.read.parquet(path).schema
    except AnalysisException as problem:
        return str(problem).split("\n")[0]
    except Py4JJavaError as problem:
        unread = [c for c in UNREADABLE if c in str(problem)]
        if not unread:
            raise
        return unread[0]


def _scan_large(spark: SparkSession, files: DataFrame) -> tuple[list[Lake], DataFrame]:
    """Lakes of the files, one for each schema among them, and (path, error) of files Spark cannot read.

    Tasks read the footers, so the driver opens one file for each different schema. Only where tasks
    cannot open a file, as behind a path that Spark alone knows, does the driver read its footer, a
    few at a time.
    """
    keyed = stage(files.select("path").mapInArrow(_footers, "path string, key string"), "footers")
    schemas, errors = {}, {}
    for key, path in keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("path")).collect():
        found = _spark_schema(spark, path)
        (errors if isinstance(found, str) else schemas)[key] = found
    rest = [r.path for r in keyed.where("key IS NULL").select("path").collect()]
    with ThreadPoolExecutor(16) as pool:
        answers = list(pool.map(lambda path: _spark_schema(spark, path), rest))
    singles: dict[str, list[str]] = {}
    for path, found in zip(rest, answers, strict=True):
        if not isinstance(found, str):
            schemas.setdefault(found.json(), found)
            singles.setdefault(found.json(), []).append(path)
    broken = [(path, found) for path, found in zip(rest, answers, strict=True) if isinstance(found, str)]
    rejected = keyed.join(
        F.broadcast(spark.createDataFrame(list(errors.items()), "key string, error string")), "key"
    ).select("path", "error").union(spark.createDataFrame(broken, "path string, error string"))
    file, lakes = F.col("_metadata.file_path"), []
    for key, schema in schemas.items():
        # A reader takes the names of its files from the driver.
        own = singles.get(key) or [r.path for r in keyed.where(F.col("key") == key).select("path").collect()]
        tables = spark.createDataFrame([(path,) for path in own], "table_id string")
        lakes.append(_one_schema(spark.read.schema(schema).parquet(*own), file, tables))
    return lakes, rejected


# ---- lakes ---------------------------------------------------------------------------------------


def scan_lake(
    spark: SparkSession,
    root: Root,
    file_type: str = "csv",
    small_file_bytes: int = SMALL_FILE_BYTES,
    typed: bool = True,
) -> Scan:
    """All files of a type under `root`, a table each, named by their paths.

    `small_file_bytes` is for Parquet: files up to it are parsed whole inside tasks. `typed` is for
    CSV: whether types are inferred.
    """
    ship_package(spark)
    if file_type != "parquet":
        return scan_csv(spark, root, file_type, typed)
    small = _scan_small(spark, root, small_file_bytes)
    large = list_tables(spark, root, file_type).filter(F.col("length") > small_file_bytes)
    lakes, rejected = _scan_large(spark, large)
    return Scan(union_lakes(small.lake, *lakes), small.rejected.union(rejected))


@dataclass(frozen=True)
class AggregatedLake:
    """Dirty tables, their clean twins under the same ids, and names (table_name, table_id)."""

    dirty: Lake
    clean: Lake
    names: DataFrame
    rejected: DataFrame


def aggregate_lake(
    spark: SparkSession,
    root: str,
    dirty_name: str = "dirty.csv",
    clean_name: str = "clean.csv",
    file_type: str = "csv",
    layout: str = r"([^/]+)/([^/]+)$",
) -> AggregatedLake:
    """A lake laid out as `<root>/<table>/{dirty,clean}.csv`, tables renumbered 0 to n-1 by name.

    `layout` finds the table's and the twin's name in a path, for other layouts such as the folders
    that Spark writes. All files are scanned together, so that twins are read alike.
    """
    scan = scan_lake(spark, root, file_type)

    def parts(path: Column) -> dict[str, Column]:
        return {
            "table_name": F.regexp_extract(path, layout, 1),
            "file_name": F.regexp_extract(path, layout, 2),
        }

    rows = scan.lake.rows.withColumns(parts(F.col("table_id"))).drop("table_id")
    columns = scan.lake.columns.withColumns(parts(F.col("table_id"))).drop("table_id")
    tables = (
        columns.filter(F.col("file_name").isin(dirty_name, clean_name)).select("table_name").distinct()
    )
    n = tables.count()
    names = stage(
        number_rows(tables, [], [F.col("table_name")], "table_id", largest=n).withColumn(
            "table_id", F.col("table_id").cast("string")
        ),
        "names",
    )

    def renamed(df: DataFrame, file_name: str, fields: list[str]) -> DataFrame:
        picked = df.filter(F.col("file_name") == file_name)
        if n <= 200_000:  # two short names per table
            return picked.join(F.broadcast(names), "table_name").select("table_id", *fields)
        # The number of a table by its name, spread over the rows of hot tables by a salt.
        salts = 64
        salted = names.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = picked.withColumn("_salt", F.pmod(F.xxhash64(*fields[:1]), F.lit(salts)).cast("int"))
        return spread.join(salted, ["table_name", "_salt"]).select("table_id", *fields)

    def twin(file_name: str) -> Lake:
        return Lake(
            renamed(rows, file_name, ["row_idx", "cells"]),
            renamed(columns, file_name, ["col_idx", "col_name", "base_type"]),
        )

    return AggregatedLake(twin(dirty_name), twin(clean_name), names, scan.rejected)
