"""Exact quantiles that never bring all distinct values to one task.

Spark's ``percentile`` keeps a value→count map per column and merges the maps
in one reducer. That is right while a column has a few hundred thousand rows.
Above that the target rank is first bracketed with a bounded sketch
(``percentile_approx``), the bracket is checked by counting, and the step is
repeated inside the bracket until what is left fits the exact aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT_VALUES = 200_000
SKETCH_ACCURACY = 10_000


def linear_position(n: int, q: float) -> tuple[int, float]:
    """Rank below the quantile and the weight of the next rank (linear rule)."""
    position = (n - 1) * q
    low = min(int(math.floor(position)), max(n - 1, 0))
    return low, position - low


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    qs: list[float],
    counts: dict[str, int],
    exact_values: int = EXACT_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, list[float] | None]:
    """Linear-interpolated quantiles of several expressions, one dict entry each."""
    small = {k: v for k, v in values.items() if 0 < counts[k] <= exact_values}
    large = {k: v for k, v in values.items() if counts[k] > exact_values}
    out: dict[str, list[float] | None] = {k: None for k in values}
    if small:
        grid = F.array(*[F.lit(float(q)) for q in qs])
        names = list(small)
        row = df.agg(*[F.percentile(small[k], grid).alias(f"q{i}") for i, k in enumerate(names)]).head()
        for i, k in enumerate(names):
            out[k] = [float(v) for v in row[i]]
    if large:
        ranks = {}
        for k in large:
            wanted = set()
            for q in qs:
                low, weight = linear_position(counts[k], q)
                wanted |= {low, low + 1} if weight > 0 else {low}
            ranks[k] = sorted(wanted)
        found = values_at_ranks(df, large, ranks, counts, exact_values, accuracy)
        for k in large:
            res = []
            for q in qs:
                low, weight = linear_position(counts[k], q)
                a = found[k][low]
                res.append(a if weight == 0 else a + (found[k][low + 1] - a) * weight)
            out[k] = res
    return out


def values_at_ranks(
    df: DataFrame,
    values: dict[str, Column],
    ranks: dict[str, list[int]],
    counts: dict[str, int],
    exact_values: int = EXACT_VALUES,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[int, float]]:
    """The values at given 0-based ranks of each expression's sorted non-NULL values."""
    targets = [_Bracket(k, r, counts[k]) for k in values for r in ranks[k]]
    while True:
        todo = [t for t in targets if t.needs_narrowing(exact_values)]
        if not todo:
            break
        margin = 2.0 / accuracy
        wanted: dict[tuple, list[float]] = {}  # ranks that look into the same rows share a sketch
        for t in todo:
            p = (t.rank - t.below + 0.5) / t.inside
            wanted.setdefault(t.bracket(), []).extend((max(0.0, p - margin), min(1.0, p + margin)))
        firsts = {t.bracket(): t for t in reversed(todo)}
        row = df.agg(*[F.percentile_approx(firsts[b].within(values[b[0]]), F.array(*map(F.lit, ps)), F.lit(accuracy))
                       .alias(f"s{i}") for i, (b, ps) in enumerate(wanted.items())]).head()
        found = {b: iter(zip(r[::2], r[1::2], strict=True)) for b, r in zip(wanted, row, strict=True)}
        sketches = [next(found[t.bracket()]) for t in todo]
        checks = []
        for i, t in enumerate(todo):
            lo, hi = sketches[i]
            x = t.within(values[t.name])
            checks += [F.count_if(x < lo).alias(f"b{i}"), F.count_if(x.between(lo, hi)).alias(f"n{i}")]
        counted = df.agg(*checks).head()
        for i, t in enumerate(todo):
            t.narrow(sketches[i][0], sketches[i][1], counted[2 * i], counted[2 * i + 1], accuracy)
    open_ = [t for t in targets if t.value is None]
    if open_:
        aggs = []
        for i, t in enumerate(open_):
            p = (t.rank - t.below + 0.5) / t.inside
            x = t.within(values[t.name])
            aggs.append(F.expr(f"percentile_disc({min(max(p, 0.0), 1.0)!r}D) WITHIN GROUP (ORDER BY v{i})").alias(f"r{i}"))
            t.column = x.alias(f"v{i}")
        row = df.select(*[t.column for t in open_]).agg(*aggs).head()
        for i, t in enumerate(open_):
            t.value = float(row[i])
    out: dict[str, dict[int, float]] = {k: {} for k in values}
    for t in targets:
        out[t.name][t.rank] = t.value
    return out


class _Bracket:
    """A value interval known to contain the wanted rank."""

    def __init__(self, name: str, rank: int, n: int):
        self.name, self.rank = name, rank
        self.below, self.inside = 0, n
        self.lo = self.hi = None
        self.distinct_bound = n
        self.value = None
        self.column = None
        self.stuck = False

    def needs_narrowing(self, exact_values: int) -> bool:
        return self.value is None and not self.stuck and self.distinct_bound > exact_values

    def bracket(self) -> tuple:
        return self.name, self.lo, self.hi

    def within(self, x: Column) -> Column:
        return x if self.lo is None else F.when(x.between(self.lo, self.hi), x)

    def narrow(self, lo, hi, below, inside, accuracy) -> None:
        if not (self.below + below <= self.rank < self.below + below + inside):
            self.stuck = True  # the sketch missed its error bound: the exact step takes the wider bracket
            return
        bound = min(inside, 8 * self.inside // accuracy + 2)
        self.stuck = bound >= self.distinct_bound
        self.lo, self.hi = lo, hi
        self.below, self.inside, self.distinct_bound = self.below + below, inside, bound
        if lo == hi:
            self.value = float(lo)
