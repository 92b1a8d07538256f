"""Checks over one subject's values in time order.

All columns share one window per subject: "the previous value after dropping
NULLs" is a running ``last(ignorenulls)``, so the table is neither unpivoted
nor shuffled once per column. If some subject has more rows than ``max_group``
the rows are range-partitioned by (subject, time, key) instead, windows run
inside each slice, and only the last state of a slice is carried to the next.
The number of slices follows the rows, at most one for each ``SLICE_ROWS`` of a large table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import ordered_chunks
from ..functions.schema import as_list, number, numeric_columns, quoted
from ..functions.text import sql_number
from .hits import emit, hit, no_hits, text_of, when
from .vocabulary import REPEAT_CONCEPTS

MAX_GROUP = 1_000_000
#: A slice of a large table has at least this many rows, however small ``max_group`` is; a small one has ``MIN_SLICES`` slices.
SLICE_ROWS = 200_000
MIN_SLICES = 64
FLOOR = 1e-5


def slices_of(rows: int, max_group: int) -> int:
    """Slices of about ``max_group`` rows; where that is little, as few as hold ``SLICE_ROWS`` each, so that tasks stay few."""
    return max(2, min(-(-rows // max_group), max(MIN_SLICES, -(-rows // SLICE_ROWS))))


def with_history(
    df: DataFrame, key, subject_col: str, timepoint_col: str | None, values: dict[str, Column],
    runs=(), max_group: int = MAX_GROUP,
) -> DataFrame:
    """Add ``__x_i`` (value), ``__prev_i`` (previous non-NULL value of the subject) and, for the
    names in ``runs``, ``__run_i`` (length so far of the run of equal values)."""
    order = ([quoted(timepoint_col).asc_nulls_last()] if timepoint_col else []) \
        + [quoted(k).asc() for k in as_list(key)]
    names = list(values)
    base = df.where(quoted(subject_col).isNotNull())
    frame = base.select("*", *[v.alias(f"__x_{i}") for i, v in enumerate(values.values())])
    subject = quoted(subject_col)
    rows, largest = base.groupBy(subject.alias("s")).count().agg(F.sum("count"), F.max("count")).head()
    sliced = (largest or 0) > max_group
    if sliced:
        frame = ordered_chunks(frame, [subject.asc(), *order], slices_of(rows, max_group))
        group = [subject, F.col("__chunk")]
    else:
        group = [subject]
    w = Window.partitionBy(*group).orderBy(*order)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    run_ids = [names.index(n) for n in runs]

    if sliced:
        stamp = F.struct(*([quoted(timepoint_col).isNull(), quoted(timepoint_col)] if timepoint_col else []),
                         *[quoted(k) for k in as_list(key)])
        frame = _carry(frame, subject_col, [
            *[(f"__last_{i}", F.max_by(F.col(f"__x_{i}"), F.when(F.col(f"__x_{i}").isNotNull(), stamp)), "last")
              for i in range(len(names))],
            *[(f"__seen_{i}", F.count(f"__x_{i}"), "sum") for i in run_ids]])
    prev = []
    for i in range(len(names)):
        p = F.last(f"__x_{i}", ignorenulls=True).over(before)
        prev.append((F.coalesce(p, F.col(f"__last_{i}")) if sliced else p).alias(f"__prev_{i}"))
    counts = []
    for i in run_ids:
        n = F.count(f"__x_{i}").over(upto)
        counts.append((n + F.coalesce(F.col(f"__seen_{i}"), F.lit(0)) if sliced else n).alias(f"__nth_{i}"))
    frame = frame.select("*", *prev, *counts)
    if run_ids:
        starts = []
        for i in run_ids:
            x, p = F.col(f"__x_{i}"), F.col(f"__prev_{i}")
            new_run = x.isNotNull() & (p.isNull() | (F.abs(x - p) >= 1e-6))
            starts.append(F.when(new_run, F.col(f"__nth_{i}")).alias(f"__start_{i}"))
        frame = frame.select("*", *starts)
        if sliced:
            frame = _carry(frame, subject_col, [(f"__from_{i}", F.max(f"__start_{i}"), "max") for i in run_ids])
        out = []
        for i in run_ids:
            start = F.max(f"__start_{i}").over(upto)
            start = F.coalesce(start, F.col(f"__from_{i}")) if sliced else start
            out.append(F.when(F.col(f"__x_{i}").isNotNull(), F.col(f"__nth_{i}") - start + 1).alias(f"__run_{i}"))
        frame = frame.select("*", *out)
    return frame


def _carry(frame: DataFrame, subject_col: str, states) -> DataFrame:
    """Join, to every slice of a subject, the combined state of the subject's earlier slices.

    A slice has a predecessor only if its subject crosses a slice border, so the joined
    table has fewer rows than there are slices.
    """
    subject = quoted(subject_col)
    per_slice = frame.groupBy(subject.alias("__s"), F.col("__chunk").alias("__c")).agg(
        *[agg.alias(name) for name, agg, _ in states])
    earlier = Window.partitionBy("__s").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    combine = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "max": F.max}
    carried = per_slice.select(
        "__s", "__c", F.count(F.lit(1)).over(earlier).alias("__n"),
        *[combine[how](name).over(earlier).alias(name) for name, _, how in states]
    ).where("__n > 0").drop("__n")
    joined = frame.join(carried, (subject == F.col("__s")) & (F.col("__chunk") == F.col("__c")), "left")
    return joined.drop("__s", "__c")


def _mapped_numeric(df: DataFrame, col_map: dict[str, str], key, subject_col, timepoint_col) -> list[str]:
    numeric = set(numeric_columns(df, as_list(key)))
    return [c for c in col_map if c in numeric and col_map[c] not in ("subject_id", "timepoint")]


def _shift_hit(df, c, i, concept, percent, fold) -> str:
    x, p = f"`__x_{i}`", f"`__prev_{i}`"
    if concept == "weight":
        change = f"(abs({x} - {p}) / greatest({p}, {FLOOR}D))"
        return when(f"{x} IS NOT NULL AND {p} IS NOT NULL AND {change} > {percent}", hit(
            c, "clinical_rules", "shift_percent", 0.8, text_of(df, c), x, None, f"{p} * {sql_number(1 - percent)}",
            f"{p} * {sql_number(1 + percent)}", "abnormal_longitudinal_shift",
            "Subject weight changed abnormally by {amount}% ({before} kg to {x} kg) in consecutive visits.", 4, p,
            f"{change} * 100"))
    ratio = f"(greatest({x}, {p}) / greatest(least({x}, {p}), {FLOOR}D))"
    return when(f"{x} IS NOT NULL AND {p} IS NOT NULL AND {ratio} > {fold}", hit(
        c, "clinical_rules", "shift_fold", 0.7, text_of(df, c), x, None, f"{p} / {sql_number(fold)}",
        f"{p} * {sql_number(fold)}", "abnormal_longitudinal_shift",
        f"Clinical parameter '{c}' experienced a sudden {{amount}}-fold change from {{before}} to {{x}}.", 4, p, ratio))


def _repeat_hit(df, c, i, run_length) -> str:
    return when(f"`__run_{i}` >= {int(run_length)}", hit(
        c, "clinical_rules", "repeated_values", 0.7, text_of(df, c), f"`__x_{i}`", None, 0.0, 0.0,
        "suspicious_repeated_value",
        f"Suspicious repeating values: parameter '{c}' remained exactly {{x}} for {{count}} consecutive visits.", 5,
        None, f"`__run_{i}`"))


def longitudinal(
    df: DataFrame, key, subject_col, timepoint_col, col_map: dict[str, str], percent=0.20, fold=3.0,
    run_length=3, checks=("shift", "repeat"), max_group: int = MAX_GROUP,
) -> DataFrame:
    """Weight shifts, fold changes and repeated values of all mapped columns in one window pass."""
    cols = _mapped_numeric(df, col_map, key, subject_col, timepoint_col)
    repeats = [c for c in cols if col_map[c] in REPEAT_CONCEPTS] if "repeat" in checks else []
    if not cols:
        return no_hits(df, key)
    # slices are written, so they hold what the checks read and no more
    needed = dict.fromkeys([*as_list(key), subject_col, *as_list(timepoint_col), *cols])
    frame = with_history(df.select(*[quoted(c) for c in needed]), key, subject_col, timepoint_col,
                         {c: number(df, c) for c in cols}, repeats, max_group)
    found = []
    for i, c in enumerate(cols):
        if "shift" in checks:
            found.append(_shift_hit(df, c, i, col_map[c], percent, fold))
        if c in repeats:
            found.append(_repeat_hit(df, c, i, run_length))
    return emit(frame, key, found, subject_col) if found else no_hits(df, key)


def shift_percent(df, key, subject_col, timepoint_col, cols, percent=0.20, max_group=MAX_GROUP) -> DataFrame:
    """Consecutive values that differ by more than ``percent`` of the earlier one."""
    return longitudinal(df, key, subject_col, timepoint_col, {c: "weight" for c in as_list(cols)}, percent=percent,
                        checks=("shift",), max_group=max_group)


def shift_fold(df, key, subject_col, timepoint_col, cols, fold=3.0, max_group=MAX_GROUP) -> DataFrame:
    """Consecutive values of which one is more than ``fold`` times the other."""
    return longitudinal(df, key, subject_col, timepoint_col, {c: "other" for c in as_list(cols)}, fold=fold,
                        checks=("shift",), max_group=max_group)


def repeated_values(df, key, subject_col, timepoint_col, cols, run_length=3, max_group=MAX_GROUP) -> DataFrame:
    """The third and later of equal consecutive values (within 1e-6)."""
    return longitudinal(df, key, subject_col, timepoint_col, {c: "heart_rate" for c in as_list(cols)},
                        run_length=run_length, checks=("repeat",), max_group=max_group)
