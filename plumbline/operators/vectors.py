"""Numeric rows as vectors, and blocks of nearby vectors of bounded size.

Blocks: distinct vectors are sorted along a Z-order curve and cut into runs of
equal length. A run has a bounding box, eight consecutive runs form a node of
the next level, and so on. Pairs of boxes can then be ruled out (or settled)
level by level with equi-joins, and only pairs of blocks that really may
interact are compared point by point. No block exceeds its row bound, whatever
the distribution of the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import with_row_index
from ..functions.quantiles import exact_quantiles
from ..functions.schema import as_list, number, number_sql, numeric_columns, row_key
from ..functions.text import sql_name, sql_number

FAN_BITS = 3
TOP_NODES = 64
CURVE_AXES = 6


def vector_frame(df: DataFrame, key, cols=None, vector_col: str | None = None, medians=None, carry=()) -> DataFrame:
    """(row_key, carried columns, vec): numeric columns with NULLs replaced by the column median (0 if none)."""
    k = row_key(key).alias("row_key")
    if vector_col is not None:
        return df.select(k, *carry, F.expr(f"CAST({sql_name(vector_col)} AS ARRAY<DOUBLE>) AS vec"))
    cols = cols or numeric_columns(df, as_list(key))
    medians = column_medians(df, cols) if medians is None else medians
    parts = ", ".join(f"coalesce({number_sql(df, c)}, {sql_number(medians[c])})" for c in cols)
    return df.select(k, *carry, F.expr(f"array({parts}) AS vec"))


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians for imputation, 0 for a column without values; columns without gaps cost one count."""
    row = df.agg(F.count(F.lit(1)), *[F.count(number(df, c)) for c in cols]).head()
    counts = dict(zip(cols, row[1:]))
    gaps = [c for c in cols if 0 < counts[c] < row[0]]
    out = {c: 0.0 for c in cols}
    if gaps:
        found = exact_quantiles(df, {c: number(df, c) for c in gaps}, [0.5], counts)
        out.update({c: v[0] for c, v in found.items()})
    return out


def shape_of(frame: DataFrame) -> tuple[int, int]:
    """(rows, dimensions) of a vector frame."""
    n, d = frame.selectExpr("size(vec) AS d").agg(F.count(F.lit(1)), F.max("d")).head()
    return n, d or 0


def identity(x: str) -> str:
    return x


def blocks(points: DataFrame, d: int, block_rows: int, transform: Callable[[str], str] = identity,
           one_scale: bool = False) -> DataFrame:
    """Add ``pos`` (position on the curve) and ``block`` to distinct vectors; rows are checkpointed.

    ``transform`` maps the SQL of a coordinate to the scale on which nearness is judged. ``one_scale`` cuts all axes into
    cells of one width, as distances over several axes want it: else blocks are long where an axis is, and a radius meets
    ever more of them as the rows grow.
    """
    axes = [transform(f"vec[{i}]") for i in range(d)]
    n, *spreads = points.agg(F.count(F.lit(1)), *[F.expr(f"stddev_pop({a})") for a in axes]).head()
    widest = sorted((i for i in range(d) if spreads[i]), key=lambda i: -spreads[i])[:CURVE_AXES]
    quarters = points.agg(F.count(F.lit(1)), *[F.expr(
        f"percentile_approx({axes[i]}, array(0.0, 0.25, 0.5, 0.75, 1.0), 1000)") for i in widest]).head()[1:]
    bits = min(16, 60 // len(widest)) if widest else 0
    cells = []
    units = [(q3 - q1) or (hi - lo) or 1.0 for lo, q1, mid, q3, hi in quarters]
    if one_scale and units:
        units = [max(units)] * len(units)
    # asinh: even resolution in the bulk, logarithmic in the tails
    ends = [(math.asinh((lo - mid) / unit), math.asinh((hi - mid) / unit))
            for (lo, q1, mid, q3, hi), unit in zip(quarters, units)]
    spans = [(high - low) or 1.0 for low, high in ends]
    if one_scale and spans:
        spans, bits = [max(high - low for low, high in ends) or 1.0] * len(spans), min(28, 60 // len(spans))
    for i, (lo, q1, mid, q3, hi), unit, (low, high), span in zip(widest, quarters, units, ends, spans):
        z = f"(asinh(({axes[i]} - {sql_number(mid)}) / {sql_number(unit)}) - {sql_number(low)}) / {sql_number(span)}"
        cells.append(f"CAST(floor(least(greatest({z}, 0.0D), 1.0D) * {sql_number(2 ** bits - 1)}) AS BIGINT)")
    width = len(cells)
    curve = " | ".join(f"shiftleft(shiftright(__q{a}, {bit}) & 1L, {bit * width + a})"
                       for bit in range(bits) for a in range(width)) or "0L"
    coded = points.selectExpr("*", *[f"{c} AS __q{i}" for i, c in enumerate(cells)]).selectExpr(
        *points.columns, f"{curve} AS __curve")
    ordered = with_row_index(coded, [F.col("__curve").asc(), F.col("vec").asc()], "pos",
                             parts=max(1, min(math.ceil(n / 50_000), 10_000)))
    count = max(1, math.ceil(n / block_rows))
    return ordered.drop("__curve").withColumn("block", F.expr(f"CAST(floor(pos * {count}D / {n}) AS BIGINT)"))


def box_of(d: int, low: str, high: str, prefix: str = "") -> list:
    """Aggregates ``lo`` and ``hi``: the box around the boxes (or points, where both are one column) of a group."""
    return [F.expr("array(" + ", ".join(f"min({low}[{i}])" for i in range(d)) + ")").alias(f"{prefix}lo"),
            F.expr("array(" + ", ".join(f"max({high}[{i}])" for i in range(d)) + ")").alias(f"{prefix}hi")]


def level_tables(placed: DataFrame, d: int, extra: dict[str, Column], combine: dict[str, Callable]) -> list[DataFrame]:
    """Box tables from blocks up to a level of at most ``TOP_NODES`` nodes.

    Each has node, lo, hi, n and the ``extra`` aggregates; ``combine`` says how these merge upward.
    """
    boxes = placed.groupBy(F.col("block").alias("node")).agg(
        *box_of(d, "vec", "vec"), F.count(F.lit(1)).alias("n"),
        *[c.alias(name) for name, c in extra.items()]).persist()
    levels, nodes = [boxes], boxes.count()
    while nodes > TOP_NODES:
        below = levels[-1]
        levels.append(below.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(
            *box_of(d, "lo", "hi"), F.sum("n").alias("n"),
            *[combine[name](name).alias(name) for name in extra]).persist())
        nodes = levels[-1].count()
    return levels


def side(level: DataFrame, prefix: str, parent: bool = False) -> DataFrame:
    """A level table with prefixed columns, optionally with its parent node for the join."""
    out = level.select(*[F.col(c).alias(f"{prefix}_{c}") for c in level.columns])
    return out.withColumn(f"{prefix}_up", F.shiftright(f"{prefix}_node", FAN_BITS)) if parent else out


def box_gap(lo_a: str, hi_a: str, lo_b: str, hi_b: str, d: int) -> Column:
    """Smallest Euclidean distance between two boxes (a point is a box with lo = hi)."""
    if d > 8:  # a loop in one expression instead of one expression per dimension
        gap = (f"zip_with(zip_with({lo_a}, {hi_b}, (x, y) -> x - y), zip_with({lo_b}, {hi_a}, (x, y) -> x - y), "
               "(x, y) -> greatest(x, y, 0.0D))")
        return F.expr(f"sqrt(aggregate({gap}, 0.0D, (t, g) -> t + g * g))")
    return F.expr("sqrt(" + " + ".join(
        f"pow(greatest({lo_a}[{i}] - {hi_b}[{i}], {lo_b}[{i}] - {hi_a}[{i}], 0.0D), 2)" for i in range(d)) + ")")


def work_parts(pairs: int, per_task: int = 16) -> int:
    """Partitions for block pairs: the rows are few and small, the work per pair is not."""
    return max(1, min(pairs // per_task + 1, 20_000))


def stack(series) -> np.ndarray:
    """A pandas column of equal-length lists as a 2-D array."""
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 0))


def arrow_matrix(column) -> np.ndarray:
    """An Arrow list<double> column as a 2-D array without per-row objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
