"""Outlier tests on single numeric columns.

The statistics of all columns come from three wide aggregates (one output row
each), so nothing is shuffled but partial aggregates. They then enter the
flagging step as literals: flagging is a filter and a projection on the scan,
and the outer limits of all tests reach the file reader as pushed filters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions.schema import key_equals, number, number_sql, numeric_columns, row_key
from ..functions.student import grubbs_critical
from ..functions.text import sql_name, sql_number
from .hits import Candidates, any_of, emit_all, hit, text_of, when

METHODS = ["zscore", "iqr", "modified_zscore", "grubbs", "percentile_bounds"]


@dataclass
class ColumnStats:
    """Statistics of one numeric column."""

    n: int = 0
    mean: float | None = None
    std: float | None = None
    std_pop: float | None = None
    min: float | None = None
    max: float | None = None
    skewness: float | None = None
    kurtosis: float | None = None
    quantile: dict[float, float] = field(default_factory=dict)
    mad: float | None = None
    extreme_key: object = None

    @property
    def median(self):
        return self.quantile.get(0.5)


def moments(df: DataFrame, cols: list[str]) -> dict[str, ColumnStats]:
    """Count, mean, deviations, extremes and shape of every column in one pass."""
    if not cols:
        return {}
    names = ("count", "avg", "stddev_samp", "stddev_pop", "min", "max", "skewness", "kurtosis")
    aggs = [F.expr(f"{fn}({number_sql(df, c)})") for c in cols for fn in names]
    r = df.agg(*aggs).head()
    return {c: ColumnStats(*r[8 * i: 8 * i + 8]) for i, c in enumerate(cols)}


def column_stats(
    df: DataFrame, cols: list[str], qs=(0.01, 0.25, 0.5, 0.75, 0.99), key=None, mad=False,
    exact_values: int = quantiles.EXACT_VALUES,
) -> dict[str, ColumnStats]:
    """Moments and exact quantiles; with ``mad`` also the MAD, with ``key`` the most extreme row."""
    stats = moments(df, cols)
    counts = {c: s.n for c, s in stats.items()}
    if qs:
        found = quantiles.exact_quantiles(df, {c: number(df, c) for c in cols}, list(qs), counts, exact_values)
        for c, v in found.items():
            stats[c].quantile = dict(zip(qs, v)) if v else {}
    if mad:
        known = {c: s for c, s in stats.items() if s.median is not None}
        spread = {c: F.abs(number(df, c) - F.lit(s.median)) for c, s in known.items()}
        found = quantiles.exact_quantiles(df, spread, [0.5], counts, exact_values)
        for c, v in found.items():
            stats[c].mad = v[0] if v else None
    if key is not None:
        for c, k in extreme_rows(df, key, stats).items():
            stats[c].extreme_key = k
    return stats


def _largest_deviation(s: ColumnStats) -> float:
    return max(abs(s.max - s.mean), abs(s.min - s.mean))


def extreme_rows(df: DataFrame, key, stats: dict[str, ColumnStats]) -> dict[str, object]:
    """Smallest row key among the values farthest from the mean of each column."""
    usable = {c: s for c, s in stats.items() if s.n >= 1}
    if not usable:
        return {}
    k = row_key(key)
    aggs = [F.min(F.when(F.expr(f"abs({number_sql(df, c)} - {_n(s.mean)}) = {_n(_largest_deviation(s))}"), k))
            .alias(f"k{i}") for i, (c, s) in enumerate(usable.items())]
    edge = any_of([f"{sql_name(c)} <= {_n(s.min)} OR {sql_name(c)} >= {_n(s.max)}" for c, s in usable.items()])
    row = df.where(edge).agg(*aggs).head()
    return {c: row[i] for i, c in enumerate(usable)}


_n = sql_number


class _Test:
    """One test on one column as SQL: the condition, the score, and limits outside of which hits lie."""

    def __init__(self, flagged: str, score: str, low: float, high: float, z=None, lo=None, hi=None):
        self.flagged, self.score, self.low, self.high = flagged, f"round({score}, 4)", low, high
        self.z, self.lo, self.hi = z, lo, hi


def _zscore(x: str, s: ColumnStats, threshold: float) -> _Test | None:
    if s.n < 4 or not s.std or math.isnan(s.std):
        return None
    z = f"(({x} - {_n(s.mean)}) / {_n(s.std)})"
    lo, hi = s.mean - threshold * s.std, s.mean + threshold * s.std
    slack = 1e-9 * (abs(s.mean) + s.std)
    return _Test(f"abs({z}) > {_n(threshold)}", f"least(abs({z}) / {_n(threshold * 2)}, 1.0D)",
                 lo + slack, hi - slack, f"round({z}, 4)", round(lo, 4), round(hi, 4))


def _outside(x: str, lo: float, hi: float) -> str:
    return f"({x} < {_n(lo)} OR {x} > {_n(hi)})"


def _distance(x: str, lo: float, hi: float, width: float) -> str:
    return f"(CASE WHEN {x} < {_n(lo)} THEN {_n(lo)} - {x} ELSE {x} - {_n(hi)} END / {_n(width)})"


def _iqr(x: str, s: ColumnStats, factor: float) -> _Test | None:
    if s.n < 4:
        return None
    q1, q3 = s.quantile[0.25], s.quantile[0.75]
    width = q3 - q1
    if width == 0:
        return None
    lo, hi = q1 - factor * width, q3 + factor * width
    return _Test(_outside(x, lo, hi), f"least({_distance(x, lo, hi, width)} / {_n(factor * 2)}, 1.0D)", lo, hi, None,
                 round(lo, 4), round(hi, 4))


def _modified_zscore(x: str, s: ColumnStats, threshold: float) -> _Test | None:
    if s.n < 4:
        return None
    mad = s.mad if s.mad else s.std
    if not mad:
        return None
    z = f"(0.6745D * ({x} - {_n(s.median)}) / {_n(mad)})"
    reach = threshold * mad / 0.6745
    slack = 1e-9 * (abs(s.median) + reach)
    return _Test(f"abs({z}) > {_n(threshold)}", f"least(abs({z}) / {_n(threshold * 2)}, 1.0D)",
                 s.median - reach + slack, s.median + reach - slack, f"round({z}, 4)")


def _grubbs(x: str, s: ColumnStats, alpha: float, extreme: str) -> _Test | None:
    if s.n < 6 or not s.std:
        return None
    g, critical = _largest_deviation(s) / s.std, grubbs_critical(s.n, alpha)
    if g <= critical:
        return None
    reach = _largest_deviation(s)
    slack = 1e-9 * (abs(s.mean) + reach)
    return _Test(f"(abs({x} - {_n(s.mean)}) = {_n(reach)} AND {extreme})", _n(min(g / (critical * 2), 1.0)),
                 s.mean - reach + slack, s.mean + reach - slack, round(g, 4),
                 round(s.mean - critical * s.std, 4), round(s.mean + critical * s.std, 4))


def _percentile_bounds(x: str, s: ColumnStats, lower: float, upper: float) -> _Test | None:
    if s.n < 20:
        return None
    lo, hi = s.quantile[lower / 100.0], s.quantile[upper / 100.0]
    width = hi - lo if hi != lo else 1.0
    return _Test(_outside(x, lo, hi), f"least({_distance(x, lo, hi, width)}, 1.0D)", lo, hi, None,
                 round(lo, 4), round(hi, 4))


def _candidates(df, key, cols, stats, tests, best_only=False) -> Candidates:
    """Hits of ``tests`` (method name → function of column, stats and extreme-row flag)."""
    out = Candidates()
    if "grubbs" in tests:
        out.columns = [key_equals(key, stats[c].extreme_key).alias(f"__extreme_{i}") for i, c in enumerate(cols)
                       if stats[c].extreme_key is not None]
    for i, c in enumerate(cols):
        x, s = number_sql(df, c), stats[c]
        built = [(m, t) for m, t in ((m, f(x, s, f"`__extreme_{i}`")) for m, f in tests.items()) if t is not None]
        if not built:
            continue
        out.tests.append(f"{sql_name(c)} < {_n(max(t.low for _, t in built))} OR "
                         f"{sql_name(c)} > {_n(min(t.high for _, t in built))}")
        structs = [(t, m, hit(c, "statistical", m, t.score, text_of(df, c), x, t.z, t.lo, t.hi, "statistical_outlier"))
                   for m, t in built]
        if best_only and len(structs) > 1:
            # highest rounded score wins; on a tie the earlier method in METHODS
            ranked = ", ".join(when(t.flagged, f"named_struct('s', {t.score}, 'm', {-METHODS.index(m)}, 'h', {h})")
                               for t, m, h in structs)
            out.structs.append(f"array_max(array_compact(array({ranked}))).h")
        else:
            out.structs += [when(t.flagged, h) for t, _, h in structs]
    return out


def _run(df, key, cols, stats, tests, subject_col) -> DataFrame:
    return emit_all(df, key, [_candidates(df, key, cols, stats, tests)], subject_col)


def zscore(df, key, cols=None, threshold=3.0, subject_col=None, stats=None) -> DataFrame:
    """Values more than ``threshold`` sample deviations from the mean."""
    cols = cols or numeric_columns(df, key)
    stats = stats or moments(df, cols)
    return _run(df, key, cols, stats, {"zscore": lambda x, s, e: _zscore(x, s, threshold)}, subject_col)


def sketched_stats(df: DataFrame, cols: list[str], qs=(0.01, 0.25, 0.5, 0.75, 0.99)) -> dict[str, ColumnStats]:
    """Statistics from one pass of mergeable sketches instead of exact quantiles."""
    from .sketches import column_sketches, sketch_stats
    stats = sketch_stats(column_sketches(df, cols), qs)
    return {c: stats.get(c, ColumnStats()) for c in cols}


def iqr(df, key, cols=None, factor=1.5, subject_col=None, stats=None, exact=True) -> DataFrame:
    """Values beyond ``factor`` interquartile ranges from the quartiles; ``exact=False`` sketches these in one pass."""
    cols = cols or numeric_columns(df, key)
    stats = stats or (column_stats(df, cols, (0.25, 0.75)) if exact else sketched_stats(df, cols, (0.25, 0.75)))
    return _run(df, key, cols, stats, {"iqr": lambda x, s, e: _iqr(x, s, factor)}, subject_col)


def modified_zscore(df, key, cols=None, threshold=3.5, subject_col=None, stats=None, exact=True) -> DataFrame:
    """Median/MAD z-score; falls back to the standard deviation when the MAD is zero. ``exact=False`` sketches both."""
    cols = cols or numeric_columns(df, key)
    stats = stats or (column_stats(df, cols, (0.5,), mad=True) if exact else sketched_stats(df, cols, (0.5,)))
    return _run(df, key, cols, stats,
                {"modified_zscore": lambda x, s, e: _modified_zscore(x, s, threshold)}, subject_col)


def grubbs(df, key, cols=None, alpha=0.05, subject_col=None, stats=None) -> DataFrame:
    """The single most extreme value of a column, if it exceeds the Grubbs critical value."""
    cols = cols or numeric_columns(df, key)
    stats = stats or column_stats(df, cols, (), key=key)
    return _run(df, key, cols, stats, {"grubbs": lambda x, s, e: _grubbs(x, s, alpha, e)}, subject_col)


def grubbs_statistic(df: DataFrame, key, cols=None) -> DataFrame:
    """Per column: n, the G statistic, its extreme row and value, as a lazy DataFrame."""
    cols = cols or numeric_columns(df, key)
    stats = column_stats(df, cols, (), key=key)
    k = row_key(key)
    rows = []
    for c in cols:
        s = stats[c]
        if s.n < 6 or not s.std:
            continue
        rows.append(F.when(
            key_equals(key, s.extreme_key),
            F.struct(F.lit(c).alias("column_name"), F.lit(s.n).cast("long").alias("n"),
                     number(df, c).alias("extreme_value"),
                     F.lit(_largest_deviation(s) / s.std).alias("g"))))
    return df.select(k.alias("row_key"), F.inline(F.array_compact(F.array(*rows))))


def percentile_bounds(df, key, cols=None, lower=1.0, upper=99.0, subject_col=None, stats=None, exact=True) -> DataFrame:
    """Values outside two percentiles; needs at least 20 values. ``exact=False`` sketches them."""
    cols = cols or numeric_columns(df, key)
    qs = (lower / 100.0, upper / 100.0)
    stats = stats or (column_stats(df, cols, qs) if exact else sketched_stats(df, cols, qs))
    return _run(df, key, cols, stats,
                {"percentile_bounds": lambda x, s, e: _percentile_bounds(x, s, lower, upper)}, subject_col)


def statistical_candidates(df, key, cols=None, threshold=3.0, factor=1.5, stats=None) -> Candidates:
    """All five tests; each cell keeps its highest-scoring one."""
    cols = cols or numeric_columns(df, key)
    stats = stats or column_stats(df, cols, key=key, mad=True)
    tests = {
        "zscore": lambda x, s, e: _zscore(x, s, threshold),
        "iqr": lambda x, s, e: _iqr(x, s, factor),
        "modified_zscore": lambda x, s, e: _modified_zscore(x, s, 3.5),
        "grubbs": lambda x, s, e: _grubbs(x, s, 0.05, e),
        "percentile_bounds": lambda x, s, e: _percentile_bounds(x, s, 1.0, 99.0),
    }
    return _candidates(df, key, cols, stats, tests, best_only=True)


def statistical(df, key, cols=None, threshold=3.0, factor=1.5, subject_col=None, stats=None) -> DataFrame:
    """All five tests; each cell keeps its highest-scoring one. One scan, no shuffle."""
    return emit_all(df, key, [statistical_candidates(df, key, cols, threshold, factor, stats)], subject_col)
