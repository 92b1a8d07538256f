"""Checks whose limits come from tables: baselines, and rules that differ by study.

The numeric cells of a row become narrow rows and meet their limits in an equi-join on column (and study). A limit table
is broadcast only while its counted rows are few; beyond that the join is an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import number_sql, numeric_columns, quoted, row_key
from ..functions.text import sql_number, sql_text
from .hits import Sql, hit, no_hits, subject, text_of, union_hits, when, written

#: Limit tables of more rows are joined, not broadcast; a row has some 200 bytes.
BROADCAST_ROWS = 100_000
METHODS = ("zscore", "iqr", "modified_zscore", "percentile_bounds")


def limit_side(limits: DataFrame) -> DataFrame:
    """``limits`` with a broadcast hint if they are few."""
    return F.broadcast(limits) if limits.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else limits


def numeric_cells(df: DataFrame, key, cols: list[str], subject_col=None, study_col: str | None = None,
                  concepts: dict[str, str] | None = None) -> DataFrame:
    """(row_key, subject_id, study, column_name, concept, value, x) of every cell of ``cols`` that holds a number."""
    parts = [f"named_struct('column_name', {sql_text(c)}, 'concept', {sql_text((concepts or {}).get(c, c))}, 'value', "
             f"CAST({text_of(df, c) or 'NULL'} AS STRING), 'x', {number_sql(df, c)})" for c in cols]
    study = F.lit(None) if study_col is None else quoted(study_col)
    return df.select(row_key(key).alias("row_key"), subject(subject_col), study.cast("string").alias("study"),
                     F.expr(f"inline(array({', '.join(parts)}))")).where("x IS NOT NULL")


def baseline_hits(df: DataFrame, key, base: DataFrame, methods=METHODS, subject_col=None, z: float = 3.0,
                  factor: float = 1.5, modified: float = 3.5) -> DataFrame:
    """Hits of the univariate tests against a ``baseline`` table (one row per column); the same as the tests give with the
    table's numbers as literals, but the table is part of the plan and may hold any number of columns."""
    known = {r[0] for r in base.select("column_name").distinct().collect()}  # one name for each column
    cols = [c for c in numeric_columns(df) if c in known]
    if not cols:
        return no_hits(df, key)
    stats = base.select(F.col("column_name").alias("__c"), "n", "mean", "std", "p01", "q25", "median", "q75", "p99", "mad")
    cells = numeric_cells(df, key, cols, subject_col).join(limit_side(stats), F.col("column_name") == F.col("__c"))
    n = sql_number
    score = lambda s, most: f"round(least({s} / {n(most)}, 1.0D), 4)"
    away = lambda lo, hi: f"(CASE WHEN x < {lo} THEN {lo} - x ELSE x - {hi} END)"
    wide = "(q75 - q25)"
    lo, hi = f"(q25 - {n(factor)} * {wide})", f"(q75 + {n(factor)} * {wide})"
    span = "(CASE WHEN p99 <> p01 THEN p99 - p01 ELSE 1.0D END)"
    plain, rough = "((x - mean) / std)", "(0.6745D * (x - median) / coalesce(nullif(mad, 0.0D), std))"
    tests = {
        "zscore": (f"n >= 4 AND std > 0 AND abs{plain} > {n(z)}", score(f"abs{plain}", 2 * z), f"round({plain}, 4)",
                   f"round(mean - {n(z)} * std, 4)", f"round(mean + {n(z)} * std, 4)"),
        "iqr": (f"n >= 4 AND {wide} <> 0 AND (x < {lo} OR x > {hi})", score(f"({away(lo, hi)} / {wide})", 2 * factor), None,
                f"round({lo}, 4)", f"round({hi}, 4)"),
        "modified_zscore": (f"n >= 4 AND coalesce(nullif(mad, 0.0D), std) > 0 AND abs{rough} > {n(modified)}",
                            score(f"abs{rough}", 2 * modified), f"round({rough}, 4)", None, None),
        "percentile_bounds": ("n >= 20 AND (x < p01 OR x > p99)", score(f"({away('p01', 'p99')} / {span})", 1.0), None,
                              "round(p01, 4)", "round(p99, 4)")}
    found = [when(test, hit(Sql("column_name"), "statistical", m, s, "value", "x", zs, low, high, "statistical_outlier"))
             for m, (test, s, zs, low, high) in tests.items() if m in methods]
    return written(cells.select("row_key", "subject_id", F.expr(f"inline(array_compact(array({', '.join(found)})))")))


def range_hits(df: DataFrame, key, rules: DataFrame, concepts: dict[str, str], study_col: str | None = None,
               subject_col=None) -> DataFrame:
    """Values outside the range of their column's concept, with limits that may differ by study.

    ``rules``: study, concept, low, high, unit, critical_low, critical_high; a row without study holds for all studies that
    have no row of their own for the concept. The widest limits of all studies reach the scan as a filter.
    """
    cols = [c for c in numeric_columns(df) if c in concepts]
    rules = rules.where(F.col("concept").isin(sorted(set(concepts.values()))))
    outer = {r["concept"]: (r["lo"], r["hi"]) for r in rules.groupBy("concept").agg(  # one row for each concept
        F.max(F.greatest("low", F.coalesce("critical_low", "low"))).alias("lo"),
        F.min(F.least("high", F.coalesce("critical_high", "high"))).alias("hi")).collect()}
    cols = [c for c in cols if concepts[c] in outer]
    if not cols:
        return no_hits(df, key)
    near = " OR ".join(f"{number_sql(df, c)} < {sql_number(outer[concepts[c]][0])} OR "
                       f"{number_sql(df, c)} > {sql_number(outer[concepts[c]][1])}" for c in cols)
    fields = ("low", "high", "unit", "critical_low", "critical_high")
    own = rules.where("study IS NOT NULL").select(F.col("study").alias("__study"), F.col("concept").alias("__concept"),
                                                  F.struct(*fields).alias("own"))
    common = rules.where("study IS NULL").select(F.col("concept").alias("__of"), F.struct(*fields).alias("common"))
    cells = numeric_cells(df.where(near), key, cols, subject_col, study_col, concepts)
    cells = (cells.join(limit_side(own), (F.col("study") == F.col("__study")) & (F.col("concept") == F.col("__concept")), "left")
             .join(limit_side(common), F.col("concept") == F.col("__of"), "left")
             .withColumn("r", F.coalesce("own", "common")).where("r IS NOT NULL"))
    low, high = "x < r.critical_low", "x > r.critical_high"
    number = lambda v: f"regexp_replace(CAST({v} AS STRING), '[.]0$', '')"
    # The note texts are those of the range rules.
    note = (f"CASE WHEN {low} THEN concat('Critical low value {{x}} ', r.unit, ' is below safety threshold (', {number('r.critical_low')}, ').') "
            f"WHEN {high} THEN concat('Critical high value {{x}} ', r.unit, ' is above safety threshold (', {number('r.critical_high')}, ').') "
            f"ELSE concat('Out-of-range physiological value {{x}} ', r.unit, ' (expected [', {number('r.low')}, '-', {number('r.high')}, ']).') END"
            ).replace("{{x}}", "{x}")
    critical = f"coalesce({low} OR {high}, false)"
    h = hit(Sql("column_name"), "clinical_rules", "range_rules", f"if({critical}, 1.0D, 0.8D)", "value", "x", None, "r.low",
            "r.high", Sql(f"if({critical}, 'critical_physiological_range', 'out_of_physiological_range')"), Sql(note), 1)
    flagged = when(f"{critical} OR x < r.low OR x > r.high", h)
    return written(cells.select("row_key", "subject_id", F.expr(f"inline(array_compact(array({flagged})))")))


def all_hits(df: DataFrame, key, base: DataFrame, rules: DataFrame | None = None, concepts: dict[str, str] | None = None,
             methods=METHODS, study_col=None, subject_col=None) -> DataFrame:
    """Tests against a baseline and, where there are rules, range checks."""
    parts = [baseline_hits(df, key, base, methods, subject_col)]
    if rules is not None and concepts:
        parts.append(range_hits(df, key, rules, concepts, study_col, subject_col))
    return union_hits(parts)
