import pytest
from pyspark.sql import functions as F

from plumbline.operators import ensemble, explain, quality, results
from plumbline.operators.hits import emit, hit, union_hits, when
from plumbline.plans.analysis import AnalysisConfig, analyze


def make_hits(spark, rows):
    """rows: (key, column, algo, score, seq, kind, note)"""
    parts = []
    for key, column, algo, score, seq, kind, note in rows:
        df = spark.createDataFrame([(key, 50.0)], "id long, x double")
        parts.append(emit(df, "id", [when("true", hit(column, algo, algo, score, None, "x", None, 1.0, 2.0, kind, note, seq))]))
    return union_hits(parts)


def test_weights_and_severity(spark):
    h = make_hits(spark, [(1, "a", "clinical_rules", 1.0, 1, "k", "n"), (1, "a", "statistical", 0.5, 0, "s", None),
                          (2, "a", "duplicates", 1.0, 0, "exact_duplicate", "d"), (3, "a", "missing_data", 0.2, 2, "m", "m")])
    f = {r["row_key"]: r for r in ensemble.ensemble(h).collect()}
    assert f[1]["anomaly_score"] == pytest.approx(round((0.4 + 0.1) / 0.6, 4)) and f[1]["severity"] == "CRITICAL"
    assert f[1]["detection_method"] == "statistical, clinical_rules" and f[1]["anomaly_type"] == "k"
    assert f[2]["severity"] == "CRITICAL" and 3 not in f


def test_last_rule_wins_or_highest(spark):
    h = make_hits(spark, [(1, "a", "clinical_rules", 1.0, 1, "range", "r"), (1, "a", "clinical_rules", 0.7, 4, "shift", "s")])
    assert ensemble.ensemble(h).head()["anomaly_score"] == 0.7
    assert ensemble.ensemble(h, conflict="max").head()["anomaly_score"] == 1.0


def test_quality_score_and_bands(spark):
    f = spark.createDataFrame([("CRITICAL",), ("HIGH",), ("MEDIUM",), ("LOW",)], "severity string")
    r = quality.quality_score(f, 8).head()
    assert r["quality_score"] == 92.0 and r["anomaly_rate_percent"] == 50.0
    assert quality.quality_score(f, 0).head()["quality_score"] == 0.0
    b = spark.createDataFrame([(59.9,), (75.0,), (95.0,)], "s double")
    got = b.select(*[quality.quality_band(F.col("s"), n).alias(n) for n in ("report", "screen", "label")]).collect()
    assert [tuple(r) for r in got] == [("red", "amber", "Poor"), ("amber", "green", "Good"), ("green", "green", "Excellent")]


def test_clean_table_advice(spark):
    empty = ensemble.ensemble(make_hits(spark, [(1, "a", "missing_data", 0.1, 1, "m", "m")]))
    assert [r["recommendation"][:25] for r in quality.recommendations(empty).collect()] == ["Data quality is excellent"]


def test_whole_analysis_of_the_visits(visits):
    r = analyze(visits, "id", AnalysisConfig(min_anomaly_score=0.1, subject_col="subject_id", timepoint_col="visit"))
    assert r.rows == 5 and r.findings.count() > 0
    assert 0 <= r.quality.head()["quality_score"] <= 100
    cell = r.findings.where("row_key = 4 AND column_name = 'heart_rate'").head()
    assert cell["severity"] in ("HIGH", "CRITICAL") and cell["subject_id"] == "S2"
    assert {a["status"] for a in r.algorithms.collect()} == {"completed"}
    assert r.recommendations.count() > 0 and r.profile.count() == 5


def test_config_is_checked():
    for bad in ({"contamination": 0.5}, {"zscore_threshold": 0}, {"min_anomaly_score": 1.5}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)


def test_sentences(spark):
    row = spark.createDataFrame([(240.0, 3.25, ["statistical", "lof"], 20.0, 200.0)],
                                "v double, z double, m array<string>, lo double, hi double")
    text = row.selectExpr(explain.score_text("'hr'", "v", "z", "0.85", "m", "lo", "hi")).head()[0]
    assert text == ("Value 240.0 in column 'hr' flagged by 2 method(s) (Statistical, LOF) with an anomaly confidence of "
                    "85.0%. It is 3.2 standard deviations above the mean. This is outside the expected normal range of "
                    "[20.00 to 200.00].")
    context = row.selectExpr(explain.context_text("'creatinine'", "1.0", "2.0", "3.0")).head()[0]
    assert context.startswith("Elevated creatinine")


def test_review_marks(spark):
    f = spark.createDataFrame([(1, 10, "a", False, None, False), (1, 11, "a", False, None, True)],
                              "analysis_id long, row_key long, column_name string, is_reviewed boolean, "
                              "review_note string, is_false_positive boolean")
    marks = spark.createDataFrame([(1, 10, "a", "ok")], "analysis_id long, row_key long, column_name string, note string")
    done = {r["row_key"]: r for r in results.mark_reviewed(f, marks).collect()}
    assert done[10]["is_reviewed"] and done[10]["review_note"] == "ok" and not done[11]["is_reviewed"]
    flags = spark.createDataFrame([(1, 10, "a", True), (1, 11, "a", False)],
                                  "analysis_id long, row_key long, column_name string, flag boolean")
    done = {r["row_key"]: r for r in results.mark_false_positive(f, flags).collect()}
    assert done[10]["is_false_positive"] and done[10]["is_reviewed"]
    assert not done[11]["is_false_positive"] and not done[11]["is_reviewed"]
