"""Stored sketches against exact statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import sketches, univariate
from plumbline.operators.profile import profile
from plumbline.sources import sinks


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(8)
    x, y = rng.gamma(2.0, 10.0, 20_000), rng.integers(0, 500, 20_000).astype(float)
    x[:50] = np.nan
    rows = [(i, i % 7, float(a), float(b), None if i % 9 == 0 else f"t{i % 800}") for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, day int, x double, y double, t string")


def test_merged_parts_equal_the_whole(numbers, tmp_path):
    path = str(tmp_path / "sketches")
    for days in ((0, 1, 2), (3, 4, 5, 6), (2,)):  # day 2 is stored twice
        part = numbers.where(F.col("day").isin(*days))
        sinks.write_sketches(sketches.column_sketches(part, ["x", "y", "t"], ["day"]), path, ["day"])
    stored = numbers.sparkSession.read.parquet(path)
    assert stored.count() == 7 * 3
    got = {r["column_name"]: r for r in sketches.sketch_profile(sketches.merged_sketches(stored)).collect()}
    want = {r["column_name"]: r for r in profile(numbers, ["x", "y", "t"]).collect()}
    for c, w in want.items():
        g = got[c]
        assert (g["count"], g["missing_count"], g["missing_percent"]) == (w["count"], w["missing_count"], w["missing_percent"])
        assert abs(g["unique_count"] - w["unique_count"]) <= sketches.DISTINCT_ERROR * w["unique_count"] + 1
        for f in ("mean", "std", "min", "max", "skewness", "kurtosis"):
            assert (g[f] is None) == (w[f] is None) and (w[f] is None or g[f] == pytest.approx(w[f], abs=2e-5)), (c, f)
    x = np.sort([r[0] for r in numbers.where("NOT isnan(x)").select("x").collect()])
    for q, value in sketches.sketch_stats(sketches.merged_sketches(stored))["x"].quantile.items():
        assert abs(np.searchsorted(x, value) / len(x) - q) <= sketches.RANK_ERROR + 1 / len(x)


def test_parts_can_be_merged_by_group(numbers):
    parts = sketches.column_sketches(numbers, ["x"], {"day": F.col("day"), "half": F.col("id") < 10_000})
    by_half = sketches.merged_sketches(parts, ["half"])
    assert sorted(r["total"] for r in by_half.collect()) == [10_000, 10_000]
    assert parts.count() == 14


def test_outlier_tests_on_sketches(numbers):
    for test in (univariate.iqr, univariate.modified_zscore, univariate.percentile_bounds):
        exact, near = test(numbers, "id", ["x"]).count(), test(numbers, "id", ["x"], exact=False).count()
        assert abs(exact - near) <= 3 * sketches.RANK_ERROR * 20_000


def test_sketches_of_little(numbers):
    none = sketches.column_sketches(numbers.where("false"), ["x", "t"])
    assert none.count() == 0 and sketches.sketch_profile(sketches.merged_sketches(none)).count() == 0
    holes = sketches.column_sketches(numbers.where("id < 50"), ["x", "t"])
    r = {r["column_name"]: r for r in sketches.sketch_profile(sketches.merged_sketches(holes)).collect()}
    assert (r["x"]["count"], r["x"]["mean"], r["x"]["median"], r["x"]["unique_count"]) == (0, None, None, 0)
    assert univariate.iqr(numbers.where("id < 50"), "id", ["x"], exact=False).count() == 0
    one = profile(numbers.where("id = 60"), ["y"], exact=False).first()
    assert one["std"] is None and one["skewness"] is None and one["median"] == one["min"]
