"""Column profiles as small sketches that are stored once for each part of a table and merged without reading it again.

A part is a day, a file, a batch: whatever column names it. Its sketch rows hold counts, moments about the part's mean, a
HyperLogLog sketch of the distinct values and a KLL sketch of the numbers. All of them merge, so the profile of a year is
the merge of its days, and a new day costs one pass over that day. Counts, extremes and moments are exact but for
rounding; distinct counts and ranks are off by the stated errors. Nothing is exploded or shuffled but partial sketches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import as_list, number_sql, numeric_columns, quoted, scalar_columns
from .missing import is_missing
from .univariate import ColumnStats

#: Size of the quantile sketch: a rank is off by 0.4 % of the rows at most, with a chance of 99 %.
KLL_SIZE = 800
RANK_ERROR = 0.004
#: Base-2 logarithm of the distinct sketch's size: three standard errors are 4 %.
HLL_BITS = 14
DISTINCT_ERROR = 0.04
#: Steps in which the spread around the median is read from a quantile sketch.
GRID = 2000


def column_sketches(df: DataFrame, cols=None, by=()) -> DataFrame:
    """One row for each part and column: the columns ``by``, position, column_name, dtype, is_number, total, missing,
    n, mean, m2, m3, m4 (sums of powers of deviations from the mean), low, high, values (KLL), distinct (HLL).

    ``by`` names the columns, or is a dict of names and expressions, that tell the parts apart. Missing cells (NULL, NaN,
    blank text) are counted only. Without rows there are no parts.
    """
    parts = by if isinstance(by, dict) else {c: quoted(c) for c in as_list(by)}
    cols = cols or [c for c in scalar_columns(df) if c not in parts]
    numeric = set(numeric_columns(df))
    aggs = [F.count(F.lit(1)).alias("__total")]
    for i, c in enumerate(cols):
        present = F.when(~is_missing(df, c), quoted(c))
        aggs += [F.count(present).alias(f"__k{i}"), F.hll_sketch_agg(present.cast("string"), HLL_BITS).alias(f"__d{i}")]
        if c in numeric:
            x = F.expr(number_sql(df, c))
            aggs += [f(x).alias(f"__{name}{i}") for name, f in (
                ("n", F.count), ("mean", F.avg), ("var", F.var_pop), ("skew", F.skewness), ("kurt", F.kurtosis),
                ("low", F.min), ("high", F.max), ("q", lambda v: F.kll_sketch_agg_double(v, KLL_SIZE)))]
    wide = df.groupBy(*[e.alias(n) for n, e in parts.items()]).agg(*aggs) if parts else df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        of = (lambda name: F.col(f"__{name}{i}")) if c in numeric else (lambda name: F.lit(None))
        n, var = of("n"), of("var")
        double = lambda v: v.cast("double")
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), F.lit(c in numeric).alias("is_number"),
            F.col("__total").alias("total"), (F.col("__total") - F.col(f"__k{i}")).alias("missing"),
            n.cast("long").alias("n"), double(of("mean")).alias("mean"), double(var * n).alias("m2"),
            # a constant has no shape: its higher moments are 0
            F.coalesce(F.nanvl(double(of("skew") * n * F.pow(var, 1.5)), F.lit(0.0)), F.lit(0.0)).alias("m3"),
            F.coalesce(F.nanvl(double((of("kurt") + 3) * n * var * var), F.lit(0.0)), F.lit(0.0)).alias("m4"),
            double(of("low")).alias("low"), double(of("high")).alias("high"),
            of("q").cast("binary").alias("values"), F.col(f"__d{i}").alias("distinct")))
    found = wide.where("__total > 0") if not parts else wide
    return found.select(*parts, F.inline(F.array(*rows)))


def merged_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """The sketches of all parts, or of those with equal ``by``, taken together: the same columns."""
    names = [*as_list(by), "position", "column_name"]
    n = F.col("n").cast("double")
    mean = (F.sum(F.col("mean") * n) / F.sum(n)).alias("__mean")
    # one row for each part and column, so this join is of small tables
    means = sketches.groupBy(*names).agg(mean)
    # moments about the common mean
    d, m2, m3, m4 = F.col("mean") - F.col("__mean"), F.col("m2"), F.col("m3"), F.col("m4")
    same = F.expr(" AND ".join(f"s.`{c}` <=> m.`{c}`" for c in names))
    merge = sketches.alias("s").join(means.alias("m"), same).select("s.*", "m.__mean")
    return merge.groupBy(*names).agg(
        F.first("dtype").alias("dtype"), F.first("is_number").alias("is_number"), F.sum("total").alias("total"),
        F.sum("missing").alias("missing"), F.sum("n").alias("n"), F.first("__mean", True).alias("mean"),
        F.sum(m2 + n * d * d).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d * d * d).alias("m3"),
        F.sum(m4 + 4 * d * m3 + 6 * d * d * m2 + n * d * d * d * d).alias("m4"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.kll_merge_agg_double("values").alias("values"),
        F.hll_union_agg("distinct").alias("distinct"))


def sketch_stats(sketches: DataFrame, qs=(0.01, 0.25, 0.5, 0.75, 0.99)) -> dict[str, ColumnStats]:
    """Statistics for the outlier tests from merged sketches, one row for each column: moments, quantiles and MAD."""
    grid = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])
    ranks = F.array(*[F.lit(float(q)) for q in qs])
    # GRID numbers of each column come to the driver
    rows = sketches.where("is_number").select(
        "column_name", "n", "mean", "m2", "low", "high",
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", ranks)).alias("quantiles"),
        F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", grid)).alias("grid")).collect()
    out = {}
    for r in rows:
        s = ColumnStats(n=r["n"] or 0)
        if s.n:
            s.mean, s.min, s.max = r["mean"], r["low"], r["high"]
            s.std = (r["m2"] / (s.n - 1)) ** 0.5 if s.n > 1 else None
            s.std_pop = (r["m2"] / s.n) ** 0.5
            s.quantile = dict(zip(qs, map(float, r["quantiles"])))
            middle = s.quantile.get(0.5, float(np.median(r["grid"])))
            s.mad = float(np.median(np.abs(np.array(r["grid"]) - middle)))
        out[r["column_name"]] = s
    return out


def sketch_profile(sketches: DataFrame) -> DataFrame:
    """The profile of merged sketches, in the columns of ``profile``; quartiles and distinct counts are approximate."""
    q = lambda p: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", F.lit(p)))
    spread = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    shaped = F.col("n") > 3
    return sketches.select(
        "position", "column_name", "dtype", (F.col("total") - F.col("missing")).alias("count"),
        F.col("missing").alias("missing_count"), F.round(F.col("missing") / F.col("total") * 100, 2).alias("missing_percent"),
        F.hll_sketch_estimate("distinct").alias("unique_count"),
        F.round("mean", 6).alias("mean"), F.round(q(0.5), 6).alias("median"), F.round(spread, 6).alias("std"),
        F.round("low", 6).alias("min"), F.round("high", 6).alias("max"), F.round(q(0.25), 6).alias("q25"),
        F.round(q(0.75), 6).alias("q75"),
        F.when(shaped & (F.col("m2") > 0), F.round(F.sqrt(F.col("n").cast("double")) * F.col("m3") / F.pow("m2", 1.5), 6))
        .alias("skewness"),
        F.when(shaped & (F.col("m2") > 0), F.round(F.col("n") * F.col("m4") / F.pow("m2", 2.0) - 3, 6)).alias("kurtosis"))
