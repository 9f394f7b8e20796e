"""Column expressions shared by the plans; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = "decimal(38,9)"

_DATE_TEXT = r"^\d{4}-\d{1,2}-\d{1,2}$"
_NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def safe_date(df: DataFrame, name: str) -> Column:
    """Date, or NULL where the text is no ``y-m-d`` date.

    A column already stored as DATE passes through untouched, which keeps its
    range filters pushable to the scan.  For text, the guard stops Spark from
    reading a bare year or a time part as a date.
    """
    column = F.col(name)
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.DateType):
        return column
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    return F.when(column.rlike(_DATE_TEXT), column.try_cast("date"))


def safe_long(column: Column) -> Column:
    return column.try_cast("bigint")


def safe_numeric(column: Column) -> Column:
    return column.try_cast(NUMERIC)


def not_blank(column: Column) -> Column:
    return F.nullif(column, F.lit("")).isNotNull()


def valid_id(name: str, floor: int) -> Column:
    """Non-blank id whose number lies above ``floor``; other texts drop out."""
    return not_blank(F.col(name)) & (safe_long(F.col(name)) > F.lit(floor))


def due_date(df: DataFrame, due: str, posted: str, term: str) -> Column:
    """Explicit due date, else posting date plus term (no term counts as 0)."""
    days = F.coalesce(safe_long(F.col(term)), F.lit(0)).cast("int")
    return F.coalesce(safe_date(df, due), F.date_add(safe_date(df, posted), days))


def strict_least(a: Column, b: Column) -> Column:
    """Smaller value; NULL if either is NULL (the built-in skips NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def strict_greatest(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def sorted_list(column: Column) -> Column:
    """Distinct non-null texts in order, joined by ``', '``; NULL if none.

    The set collected is the output cell itself, so it is bounded by distinct
    values and not by the rows of the group.
    """
    values = F.collect_set(column)
    return F.when(F.size(values) > 0, F.array_join(F.array_sort(values), ", "))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for NULL)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def by_cuts(value: Column, cuts: Iterable[tuple[float, str]], default: str) -> Column:
    """Label of the first cut that ``value`` reaches; cuts run downwards."""
    label = F.lit(default)
    for cut, text in sorted(cuts):
        label = F.when(value >= F.lit(cut), F.lit(text)).otherwise(label)
    return label


def ratio_or_zero(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def total(columns: Sequence[Column], zero: Column) -> Column:
    """Row-wise sum; ``zero`` when there is nothing to add."""
    return reduce(lambda a, b: a + b, columns) if columns else zero


def not_nan(column: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(column), column)


def plain_number(column: Column) -> Column:
    """Text written as a plain decimal number, as double; other texts NULL.

    The pattern keeps out forms Spark alone would accept (``1d``, ``nan``).
    """
    text = F.trim(column)
    return F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))


def brazilian_number(column: Column) -> Column:
    """Text with ``.`` for thousands and ``,`` for decimals, as double."""
    text = F.replace(F.replace(F.trim(column), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain_number(text)


def number_or_null(df: DataFrame, name: str) -> Column:
    """Any column as double; what is no number becomes NULL."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return not_nan(column.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    return plain_number(column.cast("string"))


def number_or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(number_or_null(df, name), F.lit(0.0))
