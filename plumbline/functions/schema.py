"""Column selection by type, taken from the schema only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import sql_name

_NESTED = (T.ArrayType, T.MapType, T.StructType)


def as_list(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names or [])


def numeric_columns(df: DataFrame, exclude=(), only=None) -> list[str]:
    """Names of the numeric columns; booleans count as categories, not numbers."""
    skip = set(as_list(exclude))
    names = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return names if only is None else [n for n in names if n in set(only)]


def scalar_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every column that holds one value per cell (no arrays, maps or structs)."""
    skip = set(as_list(exclude))
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, _NESTED) and f.name not in skip]


def number_sql(df: DataFrame, name: str) -> str:
    """SQL for the column as a double with NaN turned into NULL."""
    c = sql_name(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return f"CASE WHEN NOT isnan({c}) THEN CAST({c} AS DOUBLE) END"
    return f"CAST({c} AS DOUBLE)"


def number(df: DataFrame, name: str) -> Column:
    """The column as a double with NaN turned into NULL."""
    return F.expr(number_sql(df, name))


def quoted(name: str) -> Column:
    """Column reference that survives dots and spaces in header names."""
    return F.col(sql_name(name))


def row_key(key) -> Column:
    """One column for a single key, a struct for a composite one."""
    names = as_list(key)
    return quoted(names[0]) if len(names) == 1 else F.struct(*[quoted(n) for n in names])


def key_equals(key, value) -> Column:
    """Condition that picks the row with this key (a Row of parts for a composite key)."""
    names = as_list(key)
    parts = [value] if len(names) == 1 else list(value)
    test = quoted(names[0]).eqNullSafe(F.lit(parts[0]))
    for n, v in zip(names[1:], parts[1:]):
        test = test & quoted(n).eqNullSafe(F.lit(v))
    return test
