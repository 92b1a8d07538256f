"""Queries over stored findings, analyses, datasets and users."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import number, quoted, row_key
from .quality import SEVERITIES

EXPORT_FIELDS = ["id", "row_key", "column_name", "subject_id", "value", "expected_range_min", "expected_range_max",
                 "z_score", "anomaly_score", "severity", "detection_method", "anomaly_type", "clinical_significance",
                 "suggested_action", "is_reviewed", "review_note", "is_false_positive", "created_at"]


def filter_findings(
    findings: DataFrame, severity: str | None = None, column: str | None = None, is_reviewed: bool | None = None,
    detection_method: str | None = None, is_false_positive: bool | None = None, min_score: float | None = None,
    analysis_id=None,
) -> DataFrame:
    """AND of the given filters; ``detection_method`` matches a single detector in the list."""
    out = findings
    if analysis_id is not None:
        out = out.where(F.col("analysis_id") == analysis_id)
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if column:
        out = out.where(F.col("column_name") == column)
    if is_reviewed is not None:
        out = out.where(F.col("is_reviewed") == is_reviewed)
    if detection_method:
        out = out.where(F.array_contains(F.split("detection_method", ", "), detection_method))
    if is_false_positive is not None:
        out = out.where(F.col("is_false_positive") == is_false_positive)
    if min_score is not None:
        out = out.where(F.col("anomaly_score") >= min_score)
    return out


def search_datasets(datasets: DataFrame, text: str, columns=("name", "original_filename")) -> DataFrame:
    """Datasets whose name or file name contains ``text``, ignoring case."""
    wanted = F.lit(text.lower())
    test = F.lit(False)
    for c in columns:
        test = test | F.lower(c).contains(wanted)
    return datasets.where(test)


def owned_by(findings: DataFrame, analyses: DataFrame, user_id) -> DataFrame:
    """Findings of the analyses that belong to a user."""
    mine = analyses.where(F.col("user_id") == user_id).select("analysis_id")
    return findings.join(mine, "analysis_id", "left_semi")


def by_score(findings: DataFrame) -> DataFrame:
    return findings.orderBy(F.desc("anomaly_score"), "row_key", "column_name")


def page_findings(findings: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page ordered by score; ``total`` and ``total_pages`` come with every row."""
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page starts at 1 and size is between 1 and 500")
    total = findings.agg(F.count(F.lit(1)).alias("total"))
    rows = by_score(findings).offset((page - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn(  # one-row side
        "total_pages", F.ceil(F.col("total") / F.lit(size)))


def page_count(total: int, size: int) -> int:
    return math.ceil(total / size) if size > 0 else 1


def findings_summary(findings: DataFrame) -> DataFrame:
    """(section, name, n): counts by severity, column and joined method text, in one pass."""
    sections = F.array(
        F.struct(F.lit("severity").alias("section"), F.col("severity").alias("name")),
        F.struct(F.lit("column").alias("section"), F.col("column_name").alias("name")),
        F.struct(F.lit("method").alias("section"), F.col("detection_method").alias("name")))
    combos = findings.groupBy("severity", "column_name", "detection_method").agg(F.count(F.lit(1)).alias("c"))
    return combos.select("c", F.inline(sections)).groupBy("section", "name").agg(F.sum("c").alias("n"))


def _latest_marks(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Of several marks of a cell the latest by ``reviewed_at`` (if there is one) counts, then the largest."""
    keys = ["analysis_id", "row_key", "column_name"]
    order = [c for c in ("reviewed_at",) if c in marks.columns]
    values = [c for c in marks.columns if c not in (*keys, *order)]
    one = marks.groupBy(*keys).agg(F.max(F.struct(*order, *values)).alias("__mark"))
    return findings.join(one.select(*keys, *(F.col("__mark")[c].alias(c) for c in values)), keys, "left")


def mark_reviewed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings after a batch of reviews (analysis_id, row_key, column_name, note)."""
    joined = _latest_marks(findings, marks.withColumnRenamed("note", "__note").withColumn("__hit", F.lit(True)))
    hit = F.col("__hit").isNotNull()
    return (joined.withColumn("is_reviewed", F.when(hit, True).otherwise(F.col("is_reviewed")))
            .withColumn("review_note", F.when(hit, F.col("__note")).otherwise(F.col("review_note")))
            .select(*findings.columns))


def mark_false_positive(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Findings after a batch of (analysis_id, row_key, column_name, flag); true also marks as reviewed."""
    joined = _latest_marks(findings, marks.withColumnRenamed("flag", "__flag"))
    return (joined.withColumn("is_false_positive", F.coalesce("__flag", "is_false_positive"))
            .withColumn("is_reviewed", F.when(F.col("__flag"), True).otherwise(F.col("is_reviewed")))
            .select(*findings.columns))


def list_datasets(datasets: DataFrame, user_id=None, include_archived: bool = False) -> DataFrame:
    out = datasets if user_id is None else datasets.where(F.col("user_id") == user_id)
    out = out if include_archived else out.where(~F.col("is_archived"))
    return out.orderBy(F.desc("created_at"), "dataset_id")


def list_analyses(analyses: DataFrame, user_id=None, status: str | None = None, dataset_id=None) -> DataFrame:
    out = analyses
    for name, value in (("user_id", user_id), ("status", status), ("dataset_id", dataset_id)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("created_at"), "analysis_id")


def list_users(users: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return users.orderBy(F.desc("created_at"), "user_id").offset(skip).limit(limit)


def dashboard_totals(datasets: DataFrame, analyses: DataFrame, findings: DataFrame, user_id) -> DataFrame:
    """One row: datasets, analyses, mean quality of completed analyses, findings of a user."""
    mine = analyses.where(F.col("user_id") == user_id)
    d = datasets.where((F.col("user_id") == user_id) & ~F.col("is_archived")).agg(
        F.count(F.lit(1)).alias("total_datasets"))
    a = mine.agg(F.count(F.lit(1)).alias("total_analyses"), F.round(F.coalesce(F.avg(
        F.when(F.col("status") == "COMPLETED", F.col("quality_score"))), F.lit(0.0)), 1).alias("avg_quality_score"))
    f = findings.join(mine.select("analysis_id"), "analysis_id").agg(F.count(F.lit(1)).alias("total_anomalies"))
    return d.crossJoin(a).crossJoin(f)  # three one-row tables


def recent_anomalies(findings: DataFrame, analyses: DataFrame, user_id, n: int = 10) -> DataFrame:
    mine = analyses.where(F.col("user_id") == user_id).select("analysis_id")
    return (findings.join(mine, "analysis_id").select(
        "analysis_id", "row_key", "column_name", "value", "severity", "created_at")
        .orderBy(F.desc("created_at"), "row_key", "column_name").limit(n))


def recent_analyses(analyses: DataFrame, datasets: DataFrame, user_id, n: int = 5) -> DataFrame:
    """The newest analyses with their dataset's name; the cut is made before the join."""
    newest = analyses.where(F.col("user_id") == user_id).orderBy(F.desc("created_at"), "analysis_id").limit(n)
    ids = newest.select("dataset_id").distinct()
    # at most n datasets are needed: both broadcast sides have at most n rows
    named = datasets.select("dataset_id", F.col("name").alias("dataset_name")).join(
        F.broadcast(ids), "dataset_id", "left_semi")
    return newest.join(F.broadcast(named), "dataset_id", "left").select(
        "analysis_id", "created_at", "status", F.coalesce("quality_score", F.lit(0.0)).alias("quality_score"),
        F.coalesce("dataset_name", F.lit("Dataset")).alias("dataset_name"))


def anomalies_by_day(findings: DataFrame, last_day, days: int = 30, time_col: str = "created_at") -> DataFrame:
    """Dense calendar of ``days`` days up to ``last_day`` (UTC date text or column) with zero fill."""
    last = F.lit(last_day).cast("date")
    spark = findings.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"))
    counted = (findings.where(F.col(time_col).cast("date").between(F.date_sub(last, days - 1), last))
               .groupBy(F.col(time_col).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def platform_stats(users: DataFrame, datasets: DataFrame, analyses: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of five counts."""
    u = users.agg(F.count(F.lit(1)).alias("total_users"), F.count_if("is_active").alias("active_users"))
    parts = [t.agg(F.count(F.lit(1)).alias(name)) for t, name in (
        (datasets, "total_datasets"), (analyses, "total_analyses"), (findings, "total_anomalies_detected"))]
    for p in parts:  # one-row tables
        u = u.crossJoin(p)
    return u


def top_columns(findings: DataFrame, n: int = 10) -> DataFrame:
    return (findings.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "column_name").limit(n))


def severity_breakdown(findings: DataFrame) -> DataFrame:
    """Severities that occur, worst first, with their position."""
    position = F
    for i, s in enumerate(SEVERITIES):
        position = position.when(F.col("severity") == s, i)
    return (findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
            .select(position.alias("position"), "severity", "n").orderBy("position"))


def trend(df: DataFrame, findings: DataFrame, key, column: str, timepoint_col: str, subject_col: str) -> DataFrame:
    """The values of a column over time with a finding flag and the mean ± 3·std band.

    The band is a one-row aggregate; numeric time points sort as numbers, others as text.
    """
    x = number(df, column)
    band = df.agg((F.avg(x) - 3 * F.stddev_samp(x)).alias("expected_min"),
                  (F.avg(x) + 3 * F.stddev_samp(x)).alias("expected_max"))
    flagged = findings.where(F.col("column_name") == column).select("row_key").distinct().withColumn(
        "__hit", F.lit(True))
    text = quoted(timepoint_col).cast("string")
    rows = df.select(row_key(key).alias("row_key"), text.alias("timepoint"), F.coalesce(x, F.lit(0.0)).alias("value"),
                     quoted(subject_col).cast("string").alias("subject_id"))
    return (rows.join(flagged, "row_key", "left").crossJoin(F.broadcast(band))  # one-row side
            .select("row_key", "timepoint", "value", F.col("__hit").isNotNull().alias("is_anomaly"), "subject_id",
                    "expected_min", "expected_max")
            .orderBy(F.col("timepoint").try_cast("double").asc_nulls_last(), "timepoint",
                     "row_key"))


def histogram(df: DataFrame, findings: DataFrame, key, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins with count and whether any value in the bin was flagged."""
    x = number(df, column)
    lo, hi = df.agg(F.min(x), F.max(x)).head()
    if lo is None:
        lo = hi = 0.0
    width = (hi - lo) / bins if hi > lo else 1.0
    bin_of = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    flagged = findings.where(F.col("column_name") == column).select("row_key").distinct().withColumn(
        "__hit", F.lit(True))
    rows = df.select(row_key(key).alias("row_key"), bin_of.alias("bin")).where("bin IS NOT NULL")
    counted = rows.join(flagged, "row_key", "left").groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("__hit").isNotNull()).alias("is_anomaly"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("low"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))


def report_tables(findings: DataFrame, profile: DataFrame, analyses: DataFrame, advice: DataFrame,
                  algorithms: DataFrame, analysis_id, rows: int | None = None, columns: int | None = None) -> dict[str, DataFrame]:
    """The tables of the printed report; ``rows`` and ``columns`` are the page size of two of them, if wanted."""
    one = analyses.where(F.col("analysis_id") == analysis_id)
    mine = findings.where(F.col("analysis_id") == analysis_id)
    return {
        "executive_summary": one.select("analysis_id", "quality_score", "total_rows", "total_anomalies",
                                        "anomaly_rate_percent", "processing_time_seconds"),
        "severity": severity_breakdown(mine),
        "algorithms": algorithms,
        "column_statistics": _page(profile.orderBy("position"), columns).select(
            F.substring("column_name", 1, 25).alias("column_name"), "count", "missing_percent", "mean", "std", "min",
            "max"),
        "findings": report_findings(mine, rows),
        "recommendations": advice,
        "timestamps": one.select("analysis_id", "created_at", "started_at", "completed_at"),
    }


def _page(table: DataFrame, rows: int | None) -> DataFrame:
    return table if rows is None else table.limit(rows)


def report_findings(findings: DataFrame, rows: int | None = None) -> DataFrame:
    """The findings, highest score first, in the report's short form; only the first ``rows`` if given."""
    return _page(by_score(findings), rows).select(
        "row_key", F.substring("column_name", 1, 20).alias("column_name"), F.substring("value", 1, 15).alias("value"),
        F.round("anomaly_score", 2).alias("anomaly_score"), "severity",
        F.substring("detection_method", 1, 15).alias("detection_method"),
        F.substring("suggested_action", 1, 25).alias("suggested_action"))


def run_duration(analyses: DataFrame) -> DataFrame:
    """Seconds from start to completion."""
    seconds = (F.unix_micros(F.col("completed_at").cast("timestamp"))
               - F.unix_micros(F.col("started_at").cast("timestamp"))) / F.lit(1e6)
    return analyses.select("analysis_id", F.round(seconds, 6).alias("duration_seconds"))


def usage_per_hour(events: DataFrame, user_col: str, time_col: str, per_hour: int = 5) -> DataFrame:
    """Requests used and left per user and clock hour; the same code runs on a stream."""
    window = F.window(time_col, "1 hour")
    return (events.groupBy(quoted(user_col).alias("user_id"), window.alias("w"))
            .agg(F.count(F.lit(1)).alias("used"))
            .select("user_id", F.col("w.start").alias("hour"), "used", F.lit(per_hour).alias("allowed"),
                    F.greatest(F.lit(0), F.lit(per_hour) - F.col("used")).alias("remaining")))


def usage_limit_breaches(events: DataFrame, user_col: str, time_col: str, per_hour: int = 5) -> DataFrame:
    """User hours with more than ``per_hour`` requests."""
    return usage_per_hour(events, user_col, time_col, per_hour).where(F.col("used") > per_hour)


def export_rows(findings: DataFrame) -> DataFrame:
    """The export fields, highest score first; fields a table lacks are NULL."""
    have = set(findings.columns)
    ordered = by_score(findings)
    return ordered.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in EXPORT_FIELDS])
