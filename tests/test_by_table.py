"""Limits from tables: the same hits as with literals, studies with limits of their own, tables that change."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import by_table, rules, univariate
from plumbline.streaming import score

RULES = ("study string, concept string, low double, high double, unit string, critical_low double, critical_high double")


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(i, "ABC"[i % 3] if i % 7 else None, f"S{i % 5}", float(i % 50) + (400.0 if i == 33 else 0.0),
             None if i % 11 == 0 else float((i * i) % 97), i % 4) for i in range(300)]
    return spark.createDataFrame(rows, "id long, study string, subject string, x double, y double, whole int")


def plain(hits):
    return sorted(str(tuple(r[c] for c in sorted(hits.columns) if c != "seq")) for r in hits.collect())


def test_baseline_as_a_table_equals_literals(readings):
    cols = ["x", "y", "whole"]
    base = score.baseline(readings, cols)
    stats = score.load_baseline(base)
    for method, test in (("zscore", univariate.zscore), ("iqr", univariate.iqr),
                         ("modified_zscore", univariate.modified_zscore), ("percentile_bounds", univariate.percentile_bounds)):
        want = test(readings, "id", cols, subject_col="subject", stats=stats)
        got = by_table.baseline_hits(readings, "id", base, (method,), "subject")
        assert plain(got) == plain(want), method
    assert by_table.baseline_hits(readings, "id", base).where("value_num = 433").count() >= 3


def test_ranges_as_a_table_equal_literals(spark, readings):
    literal = {"pulse": (5.0, 40.0, "bpm", 2.0, 45.0), "mass": (10.0, 90.0, "kg", None, None)}
    concepts = {"x": "pulse", "y": "mass"}
    table = spark.createDataFrame([(None, c, *v) for c, v in literal.items()], RULES)
    want = rules.range_rules(readings, "id", concepts, literal, "subject")
    got = by_table.range_hits(readings, "id", table, concepts, None, "subject")
    drop = ["note", "seq"]  # the literals' thresholds are written as given
    assert plain(got.drop(*drop)) == plain(want.drop(*drop)) and got.count() > 50


def test_studies_have_their_own_limits(spark, readings):
    table = spark.createDataFrame([("A", "pulse", 0.0, 10.0, "bpm", None, None), ("B", "pulse", 0.0, 48.0, "bpm", None, None),
                                   (None, "pulse", 0.0, 30.0, "bpm", None, None)], RULES)
    got = by_table.range_hits(readings, "id", table, {"x": "pulse"}, "study")
    limit = F.when(F.col("study") == "A", 10.0).when(F.col("study") == "B", 48.0).otherwise(30.0)
    want = readings.where(F.col("x") > limit)
    assert sorted(r[0] for r in got.select("row_key").collect()) == sorted(r[0] for r in want.select("id").collect())
    only = by_table.range_hits(readings, "id", table.where("study = 'A'"), {"x": "pulse"}, "study")
    assert only.count() == readings.where("study = 'A' AND x > 10").count()
    assert by_table.range_hits(readings, "id", table, {"x": "other"}, "study").count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") >= 1 and "> 10.0" in plan  # the strictest limit is a filter


def test_a_baseline_may_change_between_arrivals(spark, readings, tmp_path):
    path = str(tmp_path)
    found = []
    for part, base_of in ((0, readings), (1, readings.withColumn("x", F.col("x") + 200.0))):
        readings.where(F.col("id") % 2 == part).select("id", "x").write.mode("append").parquet(f"{path}/in")
        score.baseline(base_of, ["x"]).write.mode("overwrite").parquet(f"{path}/base")
        stream = spark.readStream.schema("id long, x double").parquet(f"{path}/in")
        score.score_arrivals(stream, "id", f"{path}/base", f"{path}/out", f"{path}/state", methods=("zscore",))
        found.append({r[0] for r in spark.read.parquet(f"{path}/out").select("row_key").collect()})
    assert found[0] <= {k for k in range(0, 300, 2)}
    old = {r[0] for r in univariate.zscore(readings, "id", ["x"]).select("row_key").collect()}
    assert found[0] == {k for k in old if k % 2 == 0}
    new = score.load_baseline(score.baseline(readings.withColumn("x", F.col("x") + 200.0), ["x"]))
    after = {r[0] for r in univariate.zscore(readings, "id", ["x"], stats=new).select("row_key").collect()}
    assert found[1] - found[0] == {k for k in after if k % 2 == 1}
