import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import quantiles


def test_ranks_of_a_column_share_one_sketch(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=3000), rng.integers(0, 40, 3000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(x, y))],
                               "x double, y double")
    made, sketch = [], F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: made.append(1) or sketch(*a))
    counts = {"x": 3000, "y": 2000}
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    aggregates, run = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: (aggregates.append(len(made)), run(self, *a))[1])
    got = quantiles.exact_quantiles(df, {"x": F.col("x"), "y": F.col("y")}, qs, counts, exact_values=100, accuracy=100)
    assert aggregates[0] == 2  # one sketch for each column, not one for each of its ranks
    kept = np.array([b for i, b in enumerate(y) if i % 3])
    assert np.allclose(got["x"], np.quantile(x, qs)) and np.allclose(got["y"], np.quantile(kept, qs))
