"""Text forms of Arrow values, equal to those that functions.text gives Spark's columns."""

from __future__ import annotations

import json
import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def _plain(kind: pa.DataType) -> pa.DataType:
    """The type without a dictionary."""
    return kind.value_type if pa.types.is_dictionary(kind) else kind


def arrow_kind(kind: pa.DataType) -> str:
    """One of int64, float64, bool, object. Raises TypeError for types that Spark cannot read.

    Unsigned 64-bit integers are decimals to Spark.
    """
    kind = _plain(kind)
    t = pa.types
    if t.is_boolean(kind):
        return "bool"
    if t.is_uint64(kind) or t.is_floating(kind) or t.is_decimal(kind):
        return "float64"
    if t.is_integer(kind):
        return "int64"
    if t.is_time(kind) or t.is_duration(kind) or (t.is_timestamp(kind) and kind.unit == "ns"):
        raise TypeError(f"columns of {kind} are not read")
    for i in range(kind.num_fields):
        arrow_kind(kind.field(i).type)
    return "object"


def _float(x: float | None) -> str | None:
    """Zero has no sign, NaN is missing."""
    if x is None or math.isnan(x):
        return None
    return repr(x) if x else "0.0"


def _json(x, kind: pa.DataType):
    """What is written for a nested value: pairs of a map as an object, numbers as they are."""
    if x is None:
        return None
    t = pa.types
    if t.is_struct(kind):
        return {kind.field(i).name: _json(x[kind.field(i).name], kind.field(i).type) for i in range(kind.num_fields)}
    if t.is_map(kind):
        return {str(k): _json(v, kind.item_type) for k, v in x}
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind):
        return [_json(v, kind.value_type) for v in x]
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    if isinstance(x, (bool, int, str)):
        return x
    if t.is_float32(kind):
        return float(str(pc.cast(pa.scalar(x, pa.float32()), pa.string())))
    if t.is_floating(kind) or t.is_decimal(kind):
        return float(x)
    return str(x)


def arrow_texts(values: pa.Array, zone: str) -> pa.Array:
    """Canonical texts of one column; missing values stay missing.

    Nested values are JSON without spaces. Times are those of the zone, without zeros at the end of
    their fraction; bytes are read as UTF-8.
    """
    if pa.types.is_dictionary(values.type):
        values = values.dictionary_decode()
    kind, t = values.type, pa.types
    if t.is_boolean(kind):
        return pc.if_else(values, "True", "False").cast(pa.string())
    if t.is_float16(kind) or t.is_float32(kind):
        singles = values.to_numpy(zero_copy_only=False).astype("float32")
        texts = [None if math.isnan(x) else str(x) if x else "0.0" for x in singles]
        return pa.array(texts, pa.string())
    if t.is_floating(kind) or t.is_decimal(kind) or t.is_uint64(kind):
        return pa.array([_float(None if x is None else float(x)) for x in values.to_pylist()], pa.string())
    if t.is_timestamp(kind):
        values = values.cast(pa.timestamp("us", kind.tz))
        if kind.tz:
            values = pc.local_timestamp(values.cast(pa.timestamp("us", zone)))
        return pc.replace_substring_regex(values.cast(pa.string()), r"\.?0*$", "")
    if t.is_binary(kind) or t.is_large_binary(kind) or t.is_fixed_size_binary(kind):
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in values.to_pylist()], pa.string())
    if t.is_nested(kind):
        texts = [
            None if x is None else json.dumps(_json(x, kind), ensure_ascii=False, separators=(",", ":"))
            for x in values.to_pylist()
        ]
        return pa.array(texts, pa.string())
    return values.cast(pa.string())


def column_text(column: Column, zone: str) -> Column:
    """The same for a column that Spark has read."""

    @arrow_udf("string")
    def texts(values: pa.Array) -> pa.Array:
        return arrow_texts(values, zone)

    return texts(column)
