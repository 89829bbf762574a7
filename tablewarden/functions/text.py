"""Text forms of cells, tokens and text predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_TEXT = "nan"

# Patterns over whole cells (\z, as $ would also match before a final line break).
ALNUM_PATTERN = r"^[\p{L}\p{N}]+\z"
NUMERIC_TEXT_PATTERN = r"^\p{N}+\z"
INTEGER_PATTERN = r"^[+-]?[0-9]+\z"
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z|^[+-]?(inf|Infinity)\z"
BOOLEAN_PATTERN = r"^(True|False|TRUE|FALSE|true|false)\z"
# One range: a text of visible ASCII characters alone is seen to be one word in a fraction of the time.
VISIBLE_PATTERN = r"^[!-~]+\z"
# All Unicode whitespace, and the four information separators.
WHITESPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)
# The same without the space and the line break, which most texts have alone.
OTHER_WHITESPACE_CLASS = (
    r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


def is_alnum(text: Column) -> Column:
    return text.rlike(ALNUM_PATTERN)


def is_numeric_text(text: Column) -> Column:
    return text.rlike(NUMERIC_TEXT_PATTERN)


def tokens(text: Column) -> Column:
    """Pieces between runs of Unicode whitespace, without empty ones."""
    pieces = F.filter(F.split(text, WHITESPACE_CLASS + "+"), lambda t: t != "")
    # Cutting at a fixed character takes no pattern.
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")
    # Most cells are one word.
    return (
        F.when(text.rlike(VISIBLE_PATTERN), F.array(text))
        .when(~text.rlike(OTHER_WHITESPACE_CLASS), plain)
        .otherwise(pieces)
    )


def is_one_token(text: Column) -> Column:
    """Not empty and without whitespace."""
    return text.rlike(VISIBLE_PATTERN) | (~text.rlike(WHITESPACE_CLASS) & (text != ""))


def number(text: Column) -> Column:
    """DOUBLE of a numeric text, NULL for any other (so `12d` is no number)."""
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def float_text(x: Column, type_name: str = "double") -> Column:
    """Shortest decimal form, `10000000.0` rather than `1.0E7`; zero has no sign, NaN is missing."""
    value = x.cast(type_name)
    printed = value.cast("string")
    size = F.abs(value.cast("double"))
    # Almost all numbers are printed in final form. The test of the length is for versions of Java
    # before 19, which may print 17 digits where 16 identify the number.
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("string"))
        .when(value == 0, "0.0")
        .when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when(~printed.contains("E") & (F.length(printed) < 18), printed)
        .otherwise(_rewritten(value))
    )


def _rewritten(value: Column) -> Column:
    """The rare forms. Lambdas name what is used several times: written out, the generated code of
    a few such columns would be too large to compile."""

    def shortest(v: Column) -> Column:
        shorter = F.format_string("%.15e", v.cast("double"))
        digits = F.rtrim(F.substring_index(shorter, "e", 1), F.lit("0"))
        power = F.substring_index(shorter, "e", -1).try_cast("int").cast("string")
        figures = F.regexp_replace(F.substring_index(v.cast("string"), "E", 1), "[^0-9]", "")
        return F.when(
            (F.length(figures) >= 17) & (shorter.try_cast("double") == v),
            F.concat(digits, F.when(digits.endswith("."), "0").otherwise(""), F.lit("E"), power),
        ).otherwise(v.cast("string"))

    def written(text: Column) -> Column:
        exponent = F.substring_index(text, "E", -1).try_cast("int")
        plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
        plain = F.regexp_replace(plain, r"\.$", ".0")
        mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        figures = F.abs(exponent).cast("string")
        padded = F.when(F.abs(exponent) < 10, F.concat(F.lit("0"), figures)).otherwise(figures)
        sign = F.when(exponent < 0, "e-").otherwise("e+")
        return (
            F.when(~text.contains("E"), text)
            .when((exponent >= -4) & (exponent < 16), plain)
            .otherwise(F.concat(mantissa, sign, padded))
        )

    return F.get(F.transform(F.transform(F.array(value), shortest), written), F.lit(0))


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def cell_text(column: Column, data_type: T.DataType) -> Column:
    """Canonical text of a typed value; NULL stays NULL."""
    if isinstance(data_type, T.DoubleType):
        return float_text(column)
    if isinstance(data_type, T.FloatType):
        return float_text(column, "float")
    if isinstance(data_type, T.DecimalType):
        return float_text(column)
    if isinstance(data_type, T.BooleanType):
        return F.when(column, "True").when(~column, "False")
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


def base_type(data_type: T.DataType) -> str:
    """One of int64, float64, bool, object."""
    if isinstance(data_type, T.IntegralType):
        return "int64"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    return "object"


def file_stem(path: Column) -> Column:
    """Base name of a path without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def token_difference(a: Column, b: Column) -> Column:
    """Distinct tokens that occur in exactly one of two texts."""
    ta, tb = tokens(a), tokens(b)
    return F.concat(F.array_except(ta, tb), F.array_except(tb, ta))


def mean_difference_length(a: Column, b: Column) -> Column:
    """Mean length of the tokens in exactly one of two texts, 0 if there are none."""
    lengths = F.transform(token_difference(a, b), F.length)
    total = F.aggregate(lengths, F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(total.cast("double"), F.size(lengths)), F.lit(0.0))
