import math

import numpy as np
import pytest

from plumbline.functions.quantiles import exact_quantiles, values_at_ranks
from plumbline.functions.student import grubbs_critical
from plumbline.operators import univariate as u
from pyspark.sql import functions as F


def by_key(hits):
    return {r["row_key"]: r for r in hits.collect()}


def test_zscore_flags_the_outlier(column):
    h = by_key(u.zscore(column("lab_value", [10.0] * 19 + [100.0]), "id"))
    assert set(h) == {19}
    assert h[19]["z_score"] == pytest.approx(4.2485) and h[19]["score"] == pytest.approx(0.7081)
    assert h[19]["value"] == "100.0"


def test_iqr(column):
    h = by_key(u.iqr(column("vital_sign", [1.0, 1.2, 1.1, 0.9, 1.0, 1.1, 1.0, 1.1, 1.2, 50.0]), "id"))
    assert set(h) == {9} and h[9]["score"] == 1.0
    assert (h[9]["expected_min"], h[9]["expected_max"]) == (0.7375, 1.4375)


def test_modified_zscore(column):
    h = by_key(u.modified_zscore(column("m", [10.0, 10.2, 9.8, 10.1, 10.0, 9.9, 10.0, 200.0]), "id"))
    assert set(h) == {7} and h[7]["z_score"] == pytest.approx(1281.55, abs=0.01)


def test_modified_zscore_uses_std_when_mad_is_zero(column):
    values = [10.0] * 19 + [100.0]
    h = by_key(u.modified_zscore(column("m", values), "id"))
    expected = 0.6745 * 90 / np.std(values, ddof=1)
    assert (set(h) == {19}) == (expected > 3.5)


def test_grubbs_critical_values():
    for n, value in ((6, 1.8871), (10, 2.2900), (20, 2.7082), (30, 2.9085)):
        assert grubbs_critical(n) == pytest.approx(value, abs=1e-4)


def test_grubbs_flags_one_row_and_the_first_on_a_tie(column):
    h = by_key(u.grubbs(column("x", [0.0] * 40 + [9.0, 9.0]), "id"))
    assert set(h) == {40}
    assert h[40]["z_score"] > 0


def test_percentile_bounds_needs_twenty_values(column):
    assert u.percentile_bounds(column("x", [float(i) for i in range(19)]), "id").count() == 0
    assert u.percentile_bounds(column("x", [float(i) for i in range(100)]), "id").count() == 2


def test_statistical_keeps_the_best_and_earliest_method(column):
    h = by_key(u.statistical(column("x", [float(i % 7) for i in range(60)] + [1000.0]), "id"))
    assert h[60]["method"] == "zscore" and h[60]["score"] == 1.0


def test_nan_is_missing(column):
    h = by_key(u.zscore(column("x", [10.0] * 19 + [100.0, math.nan]), "id"))
    assert set(h) == {19}


def test_few_values_and_constant_columns_give_nothing(column):
    assert u.statistical(column("x", [1.0, 2.0, 100.0]), "id").count() == 0
    assert u.statistical(column("x", [5.0] * 30), "id").count() == 0


def test_filter_reaches_the_file_reader(spark, column, tmp_path):
    path = str(tmp_path / "t")
    column("x", [10.0] * 50 + [100.0]).write.parquet(path)
    plan = u.zscore(spark.read.parquet(path), "id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "Exchange" not in plan


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_bracketed_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(0, 1e6, 20000), "ties": rng.integers(0, 5, 20000).astype(float),
         "heavy": np.concatenate([np.full(9000, 3.5), rng.pareto(0.3, 11000)])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    qs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {"x": F.col("x")}, qs, {"x": len(x)}, exact_values=50, accuracy=100)["x"]
    assert np.allclose(got, np.quantile(x, qs), rtol=1e-12, atol=0)
    ranks = [0, 7, 10000, 19999]
    found = values_at_ranks(df, {"x": F.col("x")}, {"x": ranks}, {"x": len(x)}, exact_values=50, accuracy=100)["x"]
    assert [found[r] for r in ranks] == [np.sort(x)[r] for r in ranks]
