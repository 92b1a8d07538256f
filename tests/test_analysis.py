"""Whole runs: one scan for row-local checks, own detectors, stored records."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import hits
from plumbline.plans.analysis import AnalysisConfig, Detector, analyze, detector_hits, stored_analysis
from plumbline.plans.catalog import visit_hits
from plumbline.sources import sinks

FOLDER = "/root/testdata/sf0.001"
PLAIN = {"run_isolation_forest": False, "run_lof": False, "run_autoencoder": False, "run_duplicate_check": False}


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_row_local_checks_share_a_scan(spark):
    assert scans(visit_hits(spark, FOLDER)) == 2  # one more for the checks over time


def test_candidates_of_several_detectors_equal_them_one_by_one(spark, visits):
    from plumbline.operators import missing, rules, univariate
    holes = visits.withColumn("weight", F.when(F.col("visit") == 2, None).otherwise(F.col("visit") * -1.0))
    col_map = {"heart_rate": "heart_rate", "systolic_bp": "systolic_bp", "diastolic_bp": "diastolic_bp"}
    together = hits.emit_all(holes, "id", [
        univariate.statistical_candidates(holes, "id", ["heart_rate"]), missing.missing_candidates(holes, "id"),
        missing.impossible_candidates(holes, "id"), *rules.rule_candidates(holes, col_map)])
    apart = hits.union_hits([
        univariate.statistical(holes, "id", ["heart_rate"]), missing.missing_cells(holes, "id"),
        missing.impossible_values(holes, "id"), rules.rules_all(holes, "id", col_map=col_map)])
    assert sorted(map(str, together.collect())) == sorted(map(str, apart.collect())) and apart.count() > 3


def fast(df, key):
    return df.where("heart_rate > 70").select(F.col(key).alias("row_key"), F.lit("heart_rate").alias("column_name"),
                                              F.lit(0.9).alias("score"), F.lit("too fast").alias("note"))


def test_own_detectors(visits):
    run = analyze(visits, "id", AnalysisConfig(detectors=[Detector("fast", fast, 0.5, rank=-1)], **PLAIN))
    found = {r["row_key"]: r for r in run.findings.where("column_name = 'heart_rate'").collect()}
    assert set(found) == {0, 1, 2, 4} and found[0]["detection_method"] == "fast" and found[0]["anomaly_score"] == 0.9
    assert found[4]["detection_method"].startswith("fast, ") and found[0]["anomaly_type"] == "multivariate_outlier"
    counted = {r["algorithm"]: (r["status"], r["flagged"]) for r in run.algorithms.collect()}
    assert counted["fast"] == ("completed", 4)


def test_own_detectors_that_fail(visits):
    lazy = lambda df, key: df.select(F.col(key).alias("row_key"), F.lit("c").alias("column_name"),
                                     F.raise_error(F.lit("broken sensor")).cast("double").alias("score"))
    short = lambda df, key: df.select(F.col(key).alias("row_key"))
    config = AnalysisConfig(detectors=[Detector("lazy", lazy), Detector("short", short)], strict=False, **PLAIN)
    _, _, status, _ = detector_hits(visits, "id", config)
    failed = {s[0]: s[4] for s in status if s[1] == "failed"}
    assert "broken sensor" in failed["lazy"] and "column_name, score" in failed["short"]
    with pytest.raises(Exception, match="broken sensor"):
        analyze(visits, "id", AnalysisConfig(detectors=[Detector("lazy", lazy)], **PLAIN))
    for wrong in ([Detector("lof", fast)], [Detector("a", fast), Detector("a", fast)], [Detector("a", fast, 0.0)]):
        with pytest.raises(ValueError):
            AnalysisConfig(detectors=wrong)


def test_runs_leave_records(spark, visits, tmp_path):
    path = str(tmp_path / "store")
    config = AnalysisConfig(detectors=[Detector("fast", fast, 0.5)], **PLAIN)
    first = stored_analysis(visits, "id", path, "r1", config, "d", 7)
    stored_analysis(visits.where("false"), "id", path, "r2", AnalysisConfig(**PLAIN), "d", 7)
    with pytest.raises(ValueError):
        stored_analysis(visits, "id", path, "r3", AnalysisConfig(detectors=[
            Detector("short", lambda df, key: df.select(F.col(key).alias("row_key")))], **PLAIN), "d", 7)
    stored_analysis(visits, "id", path, "r1", config, "d", 7)  # again: findings are replaced, the last record counts
    records = {r["analysis_id"]: r for r in sinks.read_records(spark, f"{path}/analyses").collect()}
    findings = spark.read.parquet(f"{path}/findings")
    assert records["r1"]["status"] == "COMPLETED" and records["r1"]["total_rows"] == 5
    assert records["r1"]["total_anomalies"] == first["total_anomalies"] == findings.where("analysis_id = 'r1'").count() > 3
    assert records["r1"]["critical"] == findings.where("analysis_id = 'r1' AND severity = 'CRITICAL'").count()
    assert (records["r2"]["total_anomalies"], records["r2"]["quality_score"]) == (0, 100.0)
    assert records["r3"]["status"] == "FAILED" and "does not give" in records["r3"]["error"]
    assert records["r3"]["total_anomalies"] is None
    assert all(r["started_at"] <= r["completed_at"] and r["processing_time_seconds"] > 0 for r in records.values())
    assert spark.read.parquet(f"{path}/detectors").where("analysis_id = 'r1' AND algorithm = 'fast'").first()["flagged"] == 4
