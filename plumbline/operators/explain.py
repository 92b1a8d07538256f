"""Plain-language texts for findings, as SQL expressions over their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import fixed_text, number_text, sql_text
from .vocabulary import CONTEXT, DUPLICATE_ACTION, MISSING_ACTION, SEVERITY_ACTIONS, UNKNOWN_CONTEXT


def _lookup(texts: dict[str, str]) -> str:
    """A constant map; unlike a chain of conditions it adds no code per entry."""
    return "map(" + ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in texts.items()) + ")"


def suggested_action(severity: str, tag: str) -> str:
    """Action by problem tag (missing, duplicate), else by severity."""
    return (f"CASE WHEN lower({tag}) LIKE '%missing%' THEN {sql_text(MISSING_ACTION)} "
            f"WHEN lower({tag}) LIKE '%duplicate%' THEN {sql_text(DUPLICATE_ACTION)} "
            f"ELSE coalesce(try_element_at({_lookup(SEVERITY_ACTIONS)}, upper({severity})), "
            "'Review flagged entry and verify against source data.') END")


def context_text(concept: str, value: str, low: str, high: str, context=None) -> str:
    """What a low or high value of the concept can mean."""
    texts = context or CONTEXT
    lows = _lookup({k: t.get("low", t.get("high")) for k, t in texts.items()})
    highs = _lookup({k: t.get("high", t.get("low")) for k, t in texts.items()})
    name = f"lower({concept})"
    return (f"CASE WHEN NOT map_contains_key({lows}, {name}) THEN {sql_text(UNKNOWN_CONTEXT)} "
            f"WHEN {value} < {low} THEN try_element_at({lows}, {name}) "
            f"WHEN {value} > {high} THEN try_element_at({highs}, {name}) "
            f"ELSE concat('Clinical variation in parameter \\'', {concept}, '\\' detected.') END")


def clean_methods(methods: str) -> str:
    """``[isolation_forest, lof]`` → ``Isolation Forest, LOF``."""
    return f"replace(initcap(replace(array_join({methods}, ', '), '_', ' ')), 'Lof', 'LOF')"


def score_text(column: str, value: str, z: str, score: str, methods: str, low: str, high: str) -> str:
    """One sentence on how strongly and by what a numeric cell was flagged."""
    return (f"concat('Value ', {number_text(value)}, ' in column \\'', {column}, '\\' flagged by ', size({methods}), "
            f"' method(s) (', {clean_methods(methods)}, ') with an anomaly confidence of ', "
            f"{fixed_text(f'({score}) * 100', 1)}, '%.', "
            f"CASE WHEN abs({z}) > 1.5 THEN concat(' It is ', {fixed_text(f'abs({z})', 1)}, ' standard deviations ', "
            f"if({z} > 0, 'above', 'below'), ' the mean.') ELSE '' END, "
            f"CASE WHEN {value} < {low} OR {value} > {high} THEN concat("
            f"' This is outside the expected normal range of [', {fixed_text(low, 2)}, ' to ', {fixed_text(high, 2)}, "
            "'].') ELSE '' END)")


def explain(findings: DataFrame, col_map: dict[str, str] | None = None) -> DataFrame:
    """Add value text, clinical significance, suggested action and the score sentence."""
    concept = f"coalesce(try_element_at({_lookup(col_map)}, column_name), column_name)" if col_map else "column_name"
    context = context_text("concept", "value_num", "coalesce(expected_range_min, 0.0D)",
                           "coalesce(expected_range_max, 0.0D)")
    general = (f"CASE WHEN value_num IS NOT NULL THEN concat({context}, ' Flagged by ', {clean_methods('methods')}, '.') "
               "ELSE concat('Value \\'', coalesce(value, 'NaN'), '\\' in column \\'', column_name, "
               "'\\' flagged by ', size(methods), ' methods.') END")
    tag = "CASE WHEN value_num IS NOT NULL THEN methods[0] ELSE anomaly_type END"
    sentence = score_text("column_name", "value_num", "z_score", "combined", "methods", "expected_range_min",
                          "expected_range_max")
    return findings.selectExpr("*", f"{concept} AS concept").selectExpr(
        "row_key", "column_name", "subject_id", "coalesce(value, 'NaN') AS value", "expected_range_min",
        "expected_range_max", "z_score", "anomaly_score", "severity", "detection_method", "anomaly_type",
        f"coalesce(note, {general}) AS clinical_significance",
        f"{suggested_action('severity', tag)} AS suggested_action",
        f"CASE WHEN value_num IS NOT NULL THEN {sentence} END AS score_text")
