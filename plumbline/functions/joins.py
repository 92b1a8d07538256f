"""Joining rows to per-group results when a few groups hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import quoted

HOT_ROWS = 1_000_000
#: Parts that the rows of a hot group are dealt to.
SALTS = 64


def salted_join(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``rows`` to one-row-per-group ``groups`` with every group copied ``salts`` times.

    A group's rows are dealt to that many tasks by a hash of the whole row, so neither a hot key nor a
    broadcast limits the size of either side.
    """
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[quoted(c) for c in rows.columns]), F.lit(salts)))
    right = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], count_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` to one-row-per-group ``groups``.

    Groups with more than ``hot_rows`` rows would land in one shuffle partition, so their rows are
    salted; all other groups use an ordinary join.
    """
    largest = groups.agg(F.max(count_col)).head()[0]
    if largest is None or largest <= hot_rows:
        return rows.join(groups, on)
    hot = groups.where(F.col(count_col) > hot_rows)
    rest = rows.join(groups.where(F.col(count_col) <= hot_rows), on)
    return salted_join(rows, hot, on).unionByName(rest)
