import pytest

from plumbline.functions.chunks import with_row_index
from plumbline.functions.text import fixed_text, number_text
from plumbline.operators import profile
from plumbline.sources import csv, files, sinks
from plumbline.streaming import score


def test_csv_policies(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(" Subject ;x;note\n001;1.5;None\n002;2;ok;too;long\n003;\n004;3;\"a;b\"\n")
    t = csv.read_csv(spark, str(path), keep_text=["Subject"])
    got = sorted(tuple(r) for r in t.collect())
    assert got == [("001", 1.5, None), ("003", None, None), ("004", 3.0, "a;b")]
    assert t.count() == 3 and dict(t.dtypes)["x"] == "double"


def test_one_column_is_rejected(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        csv.read_csv(spark, str(tmp_path / "t.csv"))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        files.validate_file(spark, str(tmp_path / "e.csv"))


def test_number_text(spark):
    cases = [(120.0, "120.0"), (12345678.9, "12345678.9"), (0.0005, "0.0005"), (1e16, "1e+16"), (1.5e-5, "1.5e-05"), (-0.25, "-0.25")]
    df = spark.createDataFrame([(c[0],) for c in cases], "x double")
    assert [r[0] for r in df.selectExpr(number_text("x")).collect()] == [c[1] for c in cases]
    ties = spark.createDataFrame([(3.25,), (4.35,), (0.15,), (1234567.0,)], "x double")
    assert [r[0] for r in ties.selectExpr(fixed_text("x", 1)).collect()] == [f"{v:.1f}" for v in (3.25, 4.35, 0.15, 1234567.0)]


def test_sanitized_text(spark):
    df = spark.createDataFrame([(" =+ -cmd",), ("-5",), ("a=b",)], "t string")
    assert [r[0] for r in files.sanitize_formula(df).collect()] == ["cmd", "5", "a=b"]


def test_row_index_is_dense(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    got = with_row_index(df, "k").collect()
    assert all(r["k"] == r["row_index"] for r in got) and len(got) == 1000


def test_imputation_and_types(spark):
    df = spark.createDataFrame([(1.0, "b", "2024-01-20"), (None, "a", "2024-01-21"), (3.0, None, None), (8.0, "a", "2024-02-01"),
                                (None, "b", "2024-02-02")], "x double, t string, d string")
    done = [tuple(r) for r in profile.impute(df).collect()]
    assert [r[0] for r in done] == [1.0, 3.0, 3.0, 8.0, 3.0] and done[2][1] == "a"
    assert profile.column_types(df) == {"x": "numeric", "t": "categorical", "d": "datetime"}
    mixed = spark.createDataFrame([("01/02/2024",), ("03/04/2024",)], "d string")
    assert profile.column_types(mixed)["d"] == "categorical"
    assert profile.column_types(mixed, ["MM/dd/yyyy"])["d"] == "datetime"


def test_findings_of_one_analysis_are_replaced(spark, tmp_path):
    path = str(tmp_path / "f")
    f = spark.createDataFrame([(1, "a", 0.9)], "row_key long, column_name string, anomaly_score double")
    sinks.write_findings(f, path, "one")
    sinks.write_findings(f.union(f), path, "two")
    sinks.write_findings(f, path, "two")
    got = {r[0]: r[1] for r in spark.read.parquet(path).groupBy("analysis_id").count().collect()}
    assert got == {"one": 1, "two": 1}


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, 10.0 if i else 500.0) for i in range(40)], "id long, x double")
    df.write.parquet(str(tmp_path / "in"))
    base = score.baseline(df, ["x"])
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = score.run_available(score.score_stream(stream, "id", base, ("zscore",)), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = score.score_stream(df, "id", base, ("zscore",))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 1


def test_quoted_line_breaks_stay_in_their_record(spark, tmp_path):
    from plumbline.sources.csv import read_csv
    path = tmp_path / "notes.csv"
    path.write_text('id,note,x\n1,"first line\nsecond line",2.5\n2,plain,3.5\n')
    rows = read_csv(spark, str(path)).orderBy("id").collect()
    assert [(r["note"], r["x"]) for r in rows] == [("first line\nsecond line", 2.5), ("plain", 3.5)]


def test_types_are_decided_on_all_values(spark):
    from plumbline.operators import profile
    df = spark.createDataFrame([("2024-01-01",)] * 20 + [("word",)] * 30, "d string")
    assert profile.column_types(df) == {"d": "categorical"}
