"""Matching names to clinical concepts.

Headers are matched on the driver (they are schema, not data). For long tables
that hold the parameter name in a column, the distinct names are matched in a
pandas UDF and joined back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.schema import quoted
from .vocabulary import HEADER_ALIASES, RULE_ALIASES


def _common_subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for ch in a:
        diagonal = 0
        for j, other in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if ch == other else max(row[j], row[j - 1])
    return row[-1]


def plain_ratio(a: str, b: str) -> float:
    """200·LCS/(len a + len b)."""
    total = len(a) + len(b)
    return 200.0 * _common_subsequence(a, b) / total if total else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and each side's shared plus own words."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = " ".join(sorted(left & right))
    rest_a, rest_b = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not rest_a or not rest_b):
        return 100.0
    lead = len(shared) + 1 if shared else 0
    full_a, full_b = lead + len(rest_a), lead + len(rest_b)
    best = 200.0 * (lead + _common_subsequence(rest_a, rest_b)) / (full_a + full_b)
    if shared:
        best = max(best, *(200.0 * len(shared) / (len(shared) + full) for full in (full_a, full_b)))
    return best


def match_name(name: str, aliases=None) -> tuple[str, float] | None:
    """Concept and score of one name under the profiling rule (cut-off 70, inclusive)."""
    aliases = aliases or HEADER_ALIASES
    text = name.lower().strip()
    known: dict[str, str] = {}
    for concept, words in aliases.items():
        for word in [concept, *words]:
            known.setdefault(word, concept)
    if text in known:
        return known[text], 100.0
    best, best_score = None, 0.0
    for word, concept in known.items():
        score = token_set_ratio(text, word)
        if score >= 70.0 and score > best_score:
            best, best_score = concept, score
    return (best, best_score) if best else None


def match_name_rules(name: str, aliases=None) -> tuple[str, float] | None:
    """Concept and score of one name under the rule-check rule (plain ratio, cut-off 80)."""
    aliases = aliases or RULE_ALIASES
    text = name.lower()
    for concept, words in aliases.items():
        if text == concept or text in words:
            return concept, 100.0
    best, best_score = None, 0.0
    for concept, words in aliases.items():
        for word in words:
            score = plain_ratio(text, word)
            if score > best_score:
                best, best_score = concept, score
    return (best, best_score) if best_score >= 80.0 else None


def map_columns(names: list[str], aliases=None) -> dict[str, str]:
    """Header → concept for the headers that match (profiling rule)."""
    found = {n: match_name(n, aliases) for n in names}
    return {n: m[0] for n, m in found.items() if m}


def map_columns_rules(names: list[str], aliases=None) -> dict[str, str]:
    """Header → concept for the headers that match (rule-check rule)."""
    found = {n: match_name_rules(n, aliases) for n in names}
    return {n: m[0] for n, m in found.items() if m}


def find_concept(col_map: dict[str, str], concept: str) -> str | None:
    """First header, in header order, that stands for ``concept``."""
    return next((name for name, c in col_map.items() if c == concept), None)


def match_distinct_names(df: DataFrame, name_col: str, rule: str = "profile", aliases=None) -> DataFrame:
    """One row per distinct name: (name, concept, match_score); unmatched names have NULLs."""
    match = match_name if rule == "profile" else match_name_rules

    @F.pandas_udf("struct<concept string, match_score double>")
    def matched(names: pd.Series) -> pd.DataFrame:
        found = [match(n, aliases) for n in names]
        return pd.DataFrame({"concept": [m and m[0] for m in found],
                             "match_score": [m and round(m[1], 4) for m in found]})

    names = df.select(quoted(name_col).alias(name_col)).where(quoted(name_col).isNotNull()).distinct()
    return names.withColumn("m", matched(quoted(name_col))).select(quoted(name_col), "m.concept", "m.match_score")


def standardise_parameters(df: DataFrame, name_col: str, rule: str = "profile", aliases=None) -> DataFrame:
    """The table with a ``concept`` column; names are matched once each, then joined back.

    A few names may stand on most rows, so the join is salted.
    """
    return salted_join(df, match_distinct_names(df, name_col, rule, aliases).drop("match_score"), [name_col], "left")
