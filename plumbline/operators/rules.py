"""Range and cross-field rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import as_list, number_sql, numeric_columns, quoted
from ..functions.text import sql_name
from .hits import Candidates, Sql, any_of, emit, emit_all, hit, text_of, when
from .longitudinal import longitudinal
from .mapping import find_concept, map_columns_rules
from .vocabulary import CLINICAL_RANGES


def range_candidates(df: DataFrame, col_map: dict[str, str] | None = None, rules=None) -> Candidates:
    """Values outside the normal or critical range of their column's concept."""
    rules = rules or CLINICAL_RANGES
    if col_map is None:
        col_map = map_columns_rules(df.columns)
    numeric = set(numeric_columns(df))
    out = Candidates()
    for c, concept in col_map.items():
        if c not in numeric or concept not in rules:
            continue
        low, high, unit, crit_low, crit_high = rules[concept]
        x = number_sql(df, c)
        critical = "critical_physiological_range"
        cases = []
        # The published note texts, here and in the rules below.
        if crit_low is not None:
            cases.append((f"{x} < {crit_low}", 1.0, critical,
                          f"Critical low value {{x}} {unit} is below safety threshold ({crit_low})."))
        if crit_high is not None:
            cases.append((f"{x} > {crit_high}", 1.0, critical,
                          f"Critical high value {{x}} {unit} is above safety threshold ({crit_high})."))
        cases.append((f"{x} < {low} OR {x} > {high}", 0.8, "out_of_physiological_range",
                      f"Out-of-range physiological value {{x}} {unit} (expected [{low}-{high}])."))
        out.structs.append("CASE " + " ".join(f"WHEN {test} THEN " + hit(
            c, "clinical_rules", "range_rules", score, text_of(df, c), x, None, low, high, kind, note, 1)
            for test, score, kind, note in cases) + " END")
        least = low if crit_low is None else max(low, crit_low)
        most = high if crit_high is None else min(high, crit_high)
        out.tests.append(f"{sql_name(c)} < {least} OR {sql_name(c)} > {most}")
    return out


def range_rules(df: DataFrame, key, col_map: dict[str, str] | None = None, rules=None, subject_col=None) -> DataFrame:
    """Values outside the normal or critical range of their column's concept.

    ``rules``: concept → (min, max, unit, critical low, critical high). Bounds enter as literals,
    so the check is one filter on the scan.
    """
    return emit_all(df, key, [range_candidates(df, col_map, rules)], subject_col)


def range_rules_long(df: DataFrame, key, name_col: str, value_col: str, rules: DataFrame, subject_col=None) -> DataFrame:
    """The same check on a long table: one row per (parameter, value), rules as a small table.

    ``rules`` has columns concept, low, high, unit, critical_low, critical_high; it holds one row per
    concept and is broadcast.
    """
    x = number_sql(df, value_col)
    names = ("concept", "low", "high", "unit", "critical_low", "critical_high")
    r = F.broadcast(rules.selectExpr(*[f"{c} AS __{c}" for c in names]))
    joined = df.join(r, quoted(name_col) == F.col("__concept"))
    critical = f"coalesce({x} < __critical_low OR {x} > __critical_high, false)"
    h = hit(Sql(sql_name(name_col)), "clinical_rules", "range_rules", f"if({critical}, 1.0, 0.8)",
            text_of(df, value_col), x, None, "__low", "__high",
            Sql(f"if({critical}, 'critical_physiological_range', 'out_of_physiological_range')"),
            Sql(f"concat(if({critical}, 'Critical value ', 'Out-of-range physiological value '), '{{x}} ', __unit, '.')"), 1)
    return emit(joined.where(f"{critical} OR {x} < __low OR {x} > __high"), key, [h], subject_col)


def field_candidates(df: DataFrame, low_col: str, high_col: str) -> Candidates:
    """Rows whose lower quantity (diastolic) is not below the upper one (systolic)."""
    low, high = number_sql(df, low_col), number_sql(df, high_col)
    h = hit(low_col, "clinical_rules", "field_order", 0.9, text_of(df, low_col), low, None, 0.0, f"{high} - 10",
            "cross_field_inconsistency",
            "Diastolic BP ({x} mmHg) is greater than or equal to Systolic BP ({before} mmHg).", 2, high)
    return Candidates([when(f"{low} >= {high}", h)], [f"{low} >= {high}"])


def field_order(df: DataFrame, key, low_col: str, high_col: str, subject_col=None) -> DataFrame:
    """Rows whose lower quantity (diastolic) is not below the upper one (systolic)."""
    return emit_all(df, key, [field_candidates(df, low_col, high_col)], subject_col)


def as_time(df: DataFrame, name: str) -> str:
    """SQL of the date or time of a cell; text that is not one becomes NULL."""
    c = sql_name(name)
    return f"try_to_timestamp({c})" if df.schema[name].dataType.typeName() == "string" else f"CAST({c} AS TIMESTAMP)"


def date_candidates(df: DataFrame, start_col: str, end_col: str) -> Candidates:
    """Rows that end before they start; empty and unreadable dates are ignored."""
    note = (f"concat('End date (', CAST({sql_name(end_col)} AS STRING), ') is earlier than start date (', "
            f"CAST({sql_name(start_col)} AS STRING), ').')")
    h = hit(end_col, "clinical_rules", "date_order", 0.8, text_of(df, end_col), None, None, 0.0, 0.0,
            "cross_field_inconsistency", Sql(note), 3)
    test = f"{as_time(df, end_col)} < {as_time(df, start_col)}"
    return Candidates([when(test, h)], [test])


def date_order(df: DataFrame, key, start_col: str, end_col: str, subject_col=None) -> DataFrame:
    """Rows that end before they start; empty and unreadable dates are ignored."""
    return emit_all(df, key, [date_candidates(df, start_col, end_col)], subject_col)


def date_columns(names: list[str]) -> tuple[str | None, str | None]:
    """First start and first end column among the headers that contain ``date``."""
    dated = [n for n in names if "date" in n.lower()]

    def first(words):
        return next((n for n in dated if any(w in n.lower() for w in words)), None)

    return (first(["start", "onset"]), first(["end", "stop", "resolution"])) if len(dated) >= 2 else (None, None)


def rule_candidates(df: DataFrame, col_map: dict[str, str], rules=None) -> list[Candidates]:
    """The rules that look at one row: ranges, field order and date order, as far as the columns are there."""
    parts = [range_candidates(df, col_map, rules)]
    systolic, diastolic = find_concept(col_map, "systolic_bp"), find_concept(col_map, "diastolic_bp")
    if systolic and diastolic:
        parts.append(field_candidates(df, diastolic, systolic))
    start, end = date_columns(df.columns)
    if start and end:
        parts.append(date_candidates(df, start, end))
    return parts


def rules_all(
    df: DataFrame, key, subject_col=None, timepoint_col=None, col_map=None, rules=None, **options,
) -> DataFrame:
    """Range, cross-field and longitudinal rules; ``seq`` keeps their order for the merge."""
    if col_map is None:
        col_map = map_columns_rules([c for c in df.columns if c not in as_list(key)])
    found = emit_all(df, key, rule_candidates(df, col_map, rules), subject_col)
    if not subject_col:
        return found
    return found.unionByName(longitudinal(df, key, subject_col, timepoint_col, col_map, **options))
