"""Missing and impossible values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import as_list, number_sql, numeric_columns, row_key, scalar_columns
from ..functions.text import fixed_text, sql_name, sql_text
from .hits import Candidates, Sql, any_of, emit, emit_all, hit, subject, text_of, union_hits, when, written
from .longitudinal import with_history
from .vocabulary import POSITIVE_PATTERNS

HIGH_RATE, SEVERE_RATE = 0.05, 0.20


def missing_sql(df: DataFrame, name: str) -> str:
    """NULL, or NaN in a floating point column."""
    c = sql_name(name)
    return f"({c} IS NULL OR isnan({c}))" if df.schema[name].dataType.typeName() in ("double", "float") \
        else f"{c} IS NULL"


def is_missing(df: DataFrame, name: str) -> Column:
    return F.expr(missing_sql(df, name))


def missing_counts(df: DataFrame, cols=None) -> DataFrame:
    """Rows and missing cells per column: one wide aggregate, then a reshape of its single row."""
    cols = cols or scalar_columns(df)
    counted = df.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.expr(f"count_if({missing_sql(df, c)})").alias(f"m{i}") for i, c in enumerate(cols)])
    entries = ", ".join(f"named_struct('position', {i}, 'column_name', {sql_text(c)}, 'missing_count', m{i})"
                        for i, c in enumerate(cols))
    return counted.selectExpr("rows", f"inline(array({entries}))")


def name_groups(name: str) -> set[str]:
    """Quantity groups whose patterns occur in the header."""
    text = name.lower()
    return {g for g, patterns in POSITIVE_PATTERNS.items() if any(p in text for p in patterns)}


def missing_rate(df: DataFrame, key, cols=None, attach_to_first: bool = False) -> DataFrame:
    """Columns with more than 5 % missing cells. ``row_key`` is NULL, or the smallest key on request."""
    cols = cols or scalar_columns(df)
    rate = "(missing_count / rows)"
    note = (f"concat('Column \\'', column_name, '\\' has a ', if({rate} > {SEVERE_RATE}, 'critical', 'high'), "
            f"' missing data rate of ', {fixed_text(rate + ' * 100', 1)}, '% (', missing_count, '/', rows, "
            "' rows missing).')")
    found = missing_counts(df, cols).where(f"rows > 0 AND {rate} > {HIGH_RATE}")
    h = hit(Sql("column_name"), "missing_data", "missing_rate", f"round({rate}, 4)", kind="high_missing_rate",
            note=Sql(note), seq=1)
    first = df.select(row_key(key).alias("row_key")).agg(F.min("row_key").alias("first_key"))
    at = F.col("first_key") if attach_to_first else F.when(F.lit(False), F.col("first_key"))
    out = found.crossJoin(F.broadcast(first)).select(  # a one-row side
        at.alias("row_key"), subject(None), F.expr(f"inline(array({h}))"))
    return written(out)


def missing_candidates(df: DataFrame, key, cols=None) -> Candidates:
    """Every missing cell: 0.5 in vital-sign columns, 0.2 elsewhere."""
    out = Candidates()
    for c in cols or scalar_columns(df, as_list(key)):
        out.tests.append(missing_sql(df, c))
        out.structs.append(when(out.tests[-1], hit(
            c, "missing_data", "missing_value", 0.5 if name_groups(c) else 0.2, kind="missing_value",
            note=f"Missing value in clinical parameter '{c}'.", seq=2)))
    return out


def missing_cells(df: DataFrame, key, cols=None, subject_col=None) -> DataFrame:
    """Every missing cell: 0.5 in vital-sign columns, 0.2 elsewhere."""
    return emit_all(df, key, [missing_candidates(df, key, cols)], subject_col)


def impossible_candidates(df: DataFrame, key, cols=None) -> Candidates:
    """Values that cannot exist: negative or zero quantities, ages and temperatures out of bounds."""
    out = Candidates()
    for c in cols or numeric_columns(df, as_list(key)):
        groups = name_groups(c)
        if not groups:
            continue
        x = number_sql(df, c)

        def at(score, note):
            return hit(c, "missing_data", "impossible_value", score, text_of(df, c), x,
                       kind="impossible_value", note=note, seq=3)

        rules = [(f"{x} < 0", 1.0, f"Impossible negative value {{x}} detected in clinical parameter '{c}'.")]
        if groups & {"weight", "height", "heart_rate", "bp", "temp"}:
            rules.append((f"{x} = 0", 0.9, f"Impossible zero value detected in clinical parameter '{c}'."))
        if "age" in groups:
            rules.append((f"{x} > 120", 0.8, "Out-of-bounds subject age: {x} years."))
        if "temp" in groups:
            rules.append((f"NOT ({x} BETWEEN 25 AND 45) AND NOT ({x} BETWEEN 77 AND 113)", 1.0,
                          "Physiologically impossible temperature value: {x}."))
        out.structs.append("CASE " + " ".join(f"WHEN {test} THEN {at(score, note)}" for test, score, note in rules) + " END")
        out.tests.append(any_of([r[0] for r in rules]))
    return out


def impossible_values(df: DataFrame, key, cols=None, subject_col=None) -> DataFrame:
    """Values that cannot exist: negative or zero quantities, ages and temperatures out of bounds."""
    return emit_all(df, key, [impossible_candidates(df, key, cols)], subject_col)


def missing_all(df: DataFrame, key, subject_col=None, attach_to_first: bool = False) -> DataFrame:
    """Missing rates, missing cells and impossible values together."""
    cells = emit_all(df, key, [missing_candidates(df, key), impossible_candidates(df, key)], subject_col)
    return union_hits([missing_rate(df, key, scalar_columns(df, as_list(key)), attach_to_first), cells])


def missing_streak(df: DataFrame, key, subject_col, timepoint_col, cols, k: int = 3, **options) -> DataFrame:
    """Cells that are the ``k``-th or later missing one in a row within a subject."""
    cols = as_list(cols)
    flags = {c: F.when(is_missing(df, c), 1.0).otherwise(0.0) for c in cols}
    history = with_history(df, key, subject_col, timepoint_col, flags, runs=cols, **options)
    found = [when(f"`__x_{i}` = 1.0 AND `__run_{i}` >= {int(k)}", hit(
        c, "missing_data", "missing_streak", 0.5, kind="missing_streak", seq=4,
        note=f"Parameter '{c}' missing for {{count}} consecutive visits.", amount=f"`__run_{i}`"))
        for i, c in enumerate(cols)]
    return emit(history, key, found, subject_col)
