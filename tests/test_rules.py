import pytest

from plumbline.operators import longitudinal as l
from plumbline.operators import mapping, missing, rules


def rows(h, *fields):
    return sorted(tuple(r[f] for f in fields) for r in h.collect())


def test_header_matching():
    assert mapping.match_name("Start_Date")[0] == "heart_rate"
    assert mapping.match_name("Study_Day_Start") == ("timepoint", 75.0)
    assert mapping.match_name("Day of birth") == ("timepoint", 100.0)
    assert mapping.match_name_rules("Temp_C")[0] == "temperature"
    assert mapping.match_name_rules("Weight_kg")[0] == "weight"
    assert mapping.match_name_rules("Height_cm") is None and mapping.match_name_rules("SpO2") is None
    found = mapping.map_columns(["PatientID", "Timepoint", "SBP"])
    assert mapping.find_concept(found, "subject_id") == "PatientID"


def test_range_rules(spark):
    df = spark.createDataFrame([(0, 72.0), (1, 240.0), (2, 301.0), (3, 15.0), (4, 9.0), (5, None)],
                               "id long, heart_rate double")
    h = rules.range_rules(df, "id")
    assert rows(h, "row_key", "score", "anomaly_type") == [
        (2, 1.0, "critical_physiological_range"), (3, 0.8, "out_of_physiological_range"),
        (4, 1.0, "critical_physiological_range")]
    notes = {r["row_key"]: r["note"] for r in h.collect()}
    assert notes[4] == "Critical low value 9.0 bpm is below safety threshold (10.0)."
    assert notes[3] == "Out-of-range physiological value 15.0 bpm (expected [20.0-250.0])."


def test_critical_low_inside_the_normal_range(spark):
    df = spark.createDataFrame([(0, -0.5), (1, 0.05), (2, 1.0)], "id long, creatinine double")
    assert rows(rules.range_rules(df, "id"), "row_key", "score") == [(0, 1.0), (1, 0.8)]


def test_cross_field_rules(spark):
    df = spark.createDataFrame(
        [(0, 120.0, 80.0, "2024-01-02", "2024-01-01"), (1, 80.0, 80.0, "2024-01-01", "bad"), (2, None, 90.0, None, "")],
        "id long, sbp double, dbp double, start_date string, end_date string")
    assert rows(rules.field_order(df, "id", "dbp", "sbp"), "row_key", "expected_max") == [(1, 70.0)]
    assert rows(rules.date_order(df, "id", "start_date", "end_date"), "row_key", "column_name") == [(0, "end_date")]
    assert rules.date_columns(["Onset_Date", "Stop_Date", "x"]) == ("Onset_Date", "Stop_Date")


def test_impossible_values(spark):
    df = spark.createDataFrame([(0, -1, 0.0, 20.0, 0.0), (1, 121, 5.0, 98.6, -2.0), (2, 0, 70.0, 37.0, 1.0)],
                               "id long, age int, weight double, body_temp double, dose double")
    h = missing.impossible_values(df, "id")
    assert rows(h, "row_key", "column_name", "score") == [
        (0, "age", 1.0), (0, "body_temp", 1.0), (0, "weight", 0.9), (1, "age", 0.8), (1, "dose", 1.0)]


def test_missing_cells_and_rates(spark):
    df = spark.createDataFrame([(i, None if i < 3 else 1.0, None if i == 0 else "a") for i in range(10)],
                               "id long, weight double, label string")
    assert rows(missing.missing_cells(df, "id"), "row_key", "column_name", "score") == [
        (0, "label", 0.2), (0, "weight", 0.5), (1, "weight", 0.5), (2, "weight", 0.5)]
    rates = missing.missing_rate(df, "id").collect()
    assert {(r["column_name"], r["score"], r["row_key"]) for r in rates} == {("weight", 0.3, None), ("label", 0.1, None)}
    assert "critical missing data rate of 30.0% (3/10 rows missing)" in [r["note"] for r in rates if r["score"] == 0.3][0]
    first = missing.missing_rate(df, "id", attach_to_first=True).collect()
    assert {r["row_key"] for r in first} == {0}


@pytest.fixture
def series(spark):
    values = [10.0, None, 10.0, 10.0, 40.0, 40.0, None, 40.0, 40.0, 5.0]
    data = [(s * 100 + i, f"s{s}", i, v) for s in range(3) for i, v in enumerate(values)]
    data.append((999, None, 1, 3.0))
    return spark.createDataFrame(data, "id long, subject string, visit int, weight double")


@pytest.mark.parametrize("max_group", [1_000_000, 4])
def test_longitudinal_checks_in_one_group_or_in_slices(series, max_group):
    shift = l.shift_percent(series, "id", "subject", "visit", "weight", max_group=max_group)
    assert rows(shift, "row_key") == [(s * 100 + i,) for s in range(3) for i in (4, 9)]
    fold = l.shift_fold(series, "id", "subject", "visit", "weight", max_group=max_group)
    assert rows(fold, "row_key") == [(s * 100 + i,) for s in range(3) for i in (4, 9)]
    repeat = l.repeated_values(series, "id", "subject", "visit", "weight", max_group=max_group)
    assert rows(repeat, "row_key") == [(s * 100 + i,) for s in range(3) for i in (3, 7, 8)]
    assert "for 4 consecutive visits" in [r["note"] for r in repeat.collect() if r["row_key"] == 8][0]


def test_missing_streak(series):
    h = missing.missing_streak(series, "id", "subject", "visit", "weight", k=1, max_group=3)
    assert rows(h, "row_key") == [(s * 100 + i,) for s in range(3) for i in (1, 6)]


def test_slices_stay_few_however_small_a_group_may_be(spark, monkeypatch):
    assert l.slices_of(10, 4) == 3  # small tables are sliced as asked
    assert l.slices_of(6_000_000, 20) <= 64  # was 300,000
    assert l.slices_of(360_000_000, 20) == 1_800
    assert l.slices_of(3_000_000, 1_000_000) == 3
    asked = []
    chunks = l.ordered_chunks
    monkeypatch.setattr(l, "ordered_chunks", lambda df, order, parts: asked.append((df.columns, parts)) or chunks(df, order, parts))
    t = spark.range(2_000).selectExpr("id", "id % 3 AS subject", "id AS visit", "IF(id < 1000, 10.0D, 100.0D) AS lab", "'x' AS other")
    got = l.shift_fold(t, "id", "subject", "visit", "lab", max_group=5)
    assert sorted(r["row_key"] for r in got.collect()) == [1000, 1001, 1002]
    (columns, parts), = asked
    assert parts == 64 and "other" not in columns
