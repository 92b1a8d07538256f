"""Summaries of findings: counts, quality score, rates, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocabulary import RECOMMENDATIONS, SEVERITY_LEVELS

SEVERITIES = [label for label, _ in SEVERITY_LEVELS]

# The three published sets of quality bands, best first.
QUALITY_BANDS = {
    "report": [("green", 80.0), ("amber", 60.0), ("red", None)],
    "screen": [("green", 70.0), ("amber", 40.0), ("red", None)],
    "label": [("Excellent", 90.0), ("Good", 75.0), ("Fair", 60.0), ("Poor", None)],
}


def by_severity(findings: DataFrame) -> DataFrame:
    """Count per severity in the order CRITICAL to LOW; empty levels are kept as zero."""
    counted = findings.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(s).alias("severity"), F.col(s).alias("n"))
                     for i, s in enumerate(SEVERITIES)])
    return counted.select(F.inline(rows))


def by_column(findings: DataFrame) -> DataFrame:
    """Findings per column, most first."""
    return findings.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "column_name")


def by_method(findings: DataFrame) -> DataFrame:
    """Findings per single detector: a cell flagged by two counts for both."""
    return (findings.select(F.explode(F.split("detection_method", ",")).alias("m"))
            .groupBy(F.trim("m").alias("method")).agg(F.count(F.lit(1)).alias("n")))


def summarise(findings: DataFrame) -> DataFrame:
    """All summary counts as (section, name, n) rows, from one pass over the findings.

    The pass keeps one row per (severity, column, method list) combination.
    """
    combos = findings.groupBy("severity", "column_name", "detection_method").agg(F.count(F.lit(1)).alias("c"))
    total = F.struct(F.lit("total").alias("section"), F.lit("total").alias("name"), F.col("c").alias("c"))
    sev = F.struct(F.lit("severity").alias("section"), F.col("severity").alias("name"), F.col("c"))
    col = F.struct(F.lit("column").alias("section"), F.col("column_name").alias("name"), F.col("c"))
    methods = F.transform(F.split("detection_method", ","), lambda m: F.struct(
        F.lit("method").alias("section"), F.trim(m).alias("name"), F.col("c").alias("c")))
    # zero rows keep every severity and the total present even without findings
    base = [("total", "total"), *[("severity", s) for s in SEVERITIES]]
    zeros = findings.sparkSession.createDataFrame(base, "section string, name string").withColumn(
        "c", F.lit(0).cast("long"))
    counted = combos.select(F.inline(F.concat(F.array(total, sev, col), methods))).unionByName(zeros)
    return counted.groupBy("section", "name").agg(F.sum("c").alias("n"))


def quality_score(findings: DataFrame, total_rows: int | DataFrame) -> DataFrame:
    """100 − 5·critical − 2·high − 0.5·others, floored at 0; also scaled per 1000 rows.

    ``total_rows`` is a number or the analysed table.
    """
    counts = findings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"),
        F.count_if(F.col("severity") == "HIGH").alias("high"))
    if isinstance(total_rows, DataFrame):
        counts = counts.crossJoin(total_rows.agg(F.count(F.lit(1)).alias("rows")))  # one row each
    else:
        counts = counts.withColumn("rows", F.lit(int(total_rows)).cast("long"))
    rest = F.greatest(F.lit(0), F.col("total") - F.col("critical") - F.col("high"))
    loss = F.col("critical") * 5.0 + F.col("high") * 2.0 + rest * 0.5
    per_1k = F.when(F.col("rows") > 0, loss * 1000.0 / F.col("rows"))

    def score(lost: Column) -> Column:
        return F.when(F.col("rows") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(100.0 - lost, 2)))

    rate = F.when(F.col("rows") > 0, F.round(F.col("total") / F.col("rows") * 100, 2)).otherwise(0.0)
    return counts.select("rows", "total", "critical", "high", score(loss).alias("quality_score"),
                         score(per_1k).alias("quality_score_per_1k"), rate.alias("anomaly_rate_percent"))


def scores_of(rows: int, total: int, critical: int, high: int) -> dict[str, float]:
    """quality_score and anomaly_rate_percent of counted findings, as ``quality_score`` has them; 100 without rows."""
    loss = critical * 5.0 + high * 2.0 + max(0, total - critical - high) * 0.5
    return {"quality_score": max(0.0, round(100.0 - loss, 2)) if rows else 100.0,
            "anomaly_rate_percent": round(total / rows * 100, 2) if rows else 0.0}


def recommendations(findings: DataFrame) -> DataFrame:
    """Ordered advice (position, recommendation) derived from the summary counts."""
    s = summarise(findings)

    def count_of(section, name):
        return F.coalesce(F.max(F.when((F.col("section") == section) & (F.col("name") == name), F.col("n"))),
                          F.lit(0))

    top = F.max(F.when(F.col("section") == "column", F.struct(F.col("n"), F.col("name"))))
    top_name = F.min_by(F.when(F.col("section") == "column", F.col("name")),
                        F.when(F.col("section") == "column", F.struct(-F.col("n"), F.col("name"))))
    one = s.agg(count_of("total", "total").alias("total"), count_of("severity", "CRITICAL").alias("critical"),
                count_of("method", "missing_data").alias("missing"),
                count_of("method", "duplicates").alias("duplicates"),
                count_of("method", "statistical").alias("statistical"),
                top["n"].alias("top_n"), top_name.alias("top_name"))

    def text(name, *args):
        parts = F.lit(RECOMMENDATIONS[name])
        for i, a in enumerate(args):
            parts = F.replace(parts, F.lit("{%d}" % i), a.cast("string"))
        return parts

    advice = F.array_compact(F.array(
        F.when(F.col("critical") > 0, text("critical", F.col("critical"))),
        F.when(F.col("missing") > 0, text("missing")),
        F.when(F.col("duplicates") > 0, text("duplicates")),
        F.when(F.col("top_n") > 3, text("column", F.col("top_name"), F.col("top_n"))),
        F.when(F.col("statistical") > 5, text("statistical"))))
    advice = F.when(F.col("total") == 0, F.array(text("clean"))).when(F.size(advice) == 0, F.array(text("other"))) \
        .otherwise(advice)
    return one.select(F.posexplode(advice).alias("position", "recommendation"))


def quality_band(score: Column, scheme: str = "report") -> Column:
    """Band of a quality score under one of the three cut-off sets."""
    chain = F
    *bands, (last, _) = QUALITY_BANDS[scheme]
    for label, least in bands:
        chain = chain.when(score >= least, label)
    return chain.otherwise(last)


def algorithm_results(hits: DataFrame, status: list[tuple]) -> DataFrame:
    """Per detector: status, rows or cells flagged, rows scored (row detectors), error.

    ``status`` lists (algorithm, status, hits per flagged item, scored, error) of the run.
    """
    counted = hits.groupBy("algo").agg(F.count(F.lit(1)).alias("n"))
    known = hits.sparkSession.createDataFrame(
        status, "algorithm string, status string, fan_out int, scored long, error string")
    return known.join(counted, known["algorithm"] == counted["algo"], "left").select(
        "algorithm", "status", (F.coalesce("n", F.lit(0)) / F.col("fan_out")).cast("long").alias("flagged"), "scored",
        "error")
