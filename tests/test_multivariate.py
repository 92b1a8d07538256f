import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.iforest import isolation_forest
from plumbline.operators.lof import lof
from plumbline.operators.reconstruct import reconstruction

neighbours = sys.modules["plumbline.operators.lof"]


def frame(spark, x, parts=4):
    schema = "id long, " + ", ".join(f"c{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], schema).repartition(parts)


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, -1)
    near = np.argsort(d, axis=1, kind="stable")[:, 1:k + 1]
    np.fill_diagonal(d, 0)
    dist = np.take_along_axis(d, near, 1)
    density = 1 / (np.maximum(dist, dist[:, -1][near]).mean(1) + 1e-10)
    return density[near].mean(1) / density


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (300, 3)), rng.normal(8, 0.1, (90, 3)), [[30.0, -30.0, 30.0]]])
    return x


@pytest.mark.parametrize("detector", [isolation_forest, lof, reconstruction])
def test_planted_outlier_and_ranges(spark, points, detector):
    r = detector(frame(spark, points), "id").toPandas().set_index("row_key")
    assert len(r) == len(points) and r["anomaly_score"].between(0, 1).all()
    assert r["anomaly_score"].idxmax() == len(points) - 1 and bool(r["is_anomaly"][len(points) - 1])
    assert abs(r["is_anomaly"].mean() - 0.05) < 0.01


@pytest.mark.parametrize("detector", [isolation_forest, lof, reconstruction])
def test_result_does_not_depend_on_partitions(spark, points, detector):
    a, b = (detector(frame(spark, points, p), "id").toPandas().sort_values("row_key")["anomaly_score"].to_numpy()
            for p in (1, 8))
    assert np.abs(a - b).max() <= 1e-3


def test_lof_equals_all_pairs(spark, points):
    r = lof(frame(spark, points), "id", block_rows=32).toPandas().sort_values("row_key")
    assert np.abs(r["raw_score"].to_numpy() - brute_lof(points, 20)).max() < 1e-4


def test_lof_with_many_copies(spark, points):
    x = np.vstack([points[:150], np.repeat(points[:1], 80, axis=0)])
    r = lof(frame(spark, x), "id", block_rows=32, hot_rows=40).toPandas().sort_values("row_key")
    expected = brute_lof(x, 20)
    assert len(r) == len(x) and np.abs(r["raw_score"].to_numpy() / expected - 1).max() < 1e-3


def test_small_tables_give_no_rows(spark):
    x = np.arange(8.0).reshape(4, 2)
    for detector in (isolation_forest, lof, reconstruction):
        assert detector(frame(spark, x), "id").count() == 0


def test_pca_reconstruction_of_a_plane(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(0, 1, (200, 2))
    x = np.column_stack([a, a.sum(1), a[:, 0] - a[:, 1]])
    x[7, 2] += 9.0
    r = reconstruction(frame(spark, x), "id", kind="pca").toPandas().set_index("row_key")
    assert r["anomaly_score"].idxmax() == 7


@pytest.mark.parametrize("n", [51_200, 51_201])
def test_trees_draw_by_one_rule_at_every_size(spark, n):
    from pyspark.sql import functions as F

    from plumbline.operators.iforest import tree_samples
    frame_ = spark.range(n).select(F.col("id").alias("row_key"), F.array(F.col("id").cast("double")).alias("vec"))
    drawn = tree_samples(frame_, n, 100, 256, 42)
    sizes = [r["n"] for r in drawn.groupBy("tree").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 100 and max(sizes) == 256 and min(sizes) > 200
    assert drawn.select(F.col("vec")[0]).distinct().count() < 100 * 256  # a row may serve several trees


def test_components_come_from_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 1)) @ np.array([[1.0, 0.9, 0.8]]) + 0.1 * rng.normal(size=(400, 3))
    z = (x - x.mean(0)) / x.std(0)
    axis = np.linalg.svd(z, full_matrices=False)[2][0]
    want = ((z - np.outer(z @ axis, axis)) ** 2).mean(1)
    got = reconstruction(frame(spark, x), "id", kind="pca", ratio=0.34).toPandas().sort_values("row_key")
    assert np.allclose(got["reconstruction_error"], want, atol=1e-4)


def test_network_is_fitted_in_few_passes(spark, monkeypatch):
    from plumbline.operators import reconstruct
    rng = np.random.default_rng(4)
    a = rng.normal(size=(600, 2))
    x = np.column_stack([a, a @ [1.0, 0.5], a @ [-0.4, 1.0]]) + 0.05 * rng.normal(size=(600, 4))
    passes = []
    summed = reconstruct._summed_gradients
    monkeypatch.setattr(reconstruct, "_summed_gradients", lambda *p: passes.append(1) or summed(*p))
    x[11, 2] += 6.0
    r = reconstruction(frame(spark, x), "id").toPandas().set_index("row_key")
    assert len(passes) <= 20 and r["anomaly_score"].idxmax() == 11
    # a line of ReLU units cannot do better than two axes, but should come near them
    z = (x - x.mean(0)) / x.std(0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    assert r["reconstruction_error"].mean() < 0.6 * (z ** 2).mean() and ((z - z @ axes.T @ axes) ** 2).mean() > 0


def test_approximate_neighbours_of_embeddings(spark):
    from plumbline.operators import lof as module
    from plumbline.plans.catalog import lof_recall
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    r = lof_recall(table, "vec_id", "embedding").first()
    assert r["vectors"] == table.count() > 3 * module.BLOCK_ROWS and r["recalled"]
    plan = module.lof(table, "vec_id", vector_col="embedding", approx=True)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_approximate_factors_count_copies(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 3)
    x[40:60] = x[40]
    x[7] = [9.0, 9.0, 9.0]
    exact = lof(frame(spark, x), "id").toPandas().set_index("row_key")["raw_score"]
    near = lof(frame(spark, x), "id", approx=True).toPandas().set_index("row_key")["raw_score"]
    assert near.idxmax() == 7 and np.allclose(exact.sort_index(), near.sort_index(), atol=1e-3)  # one run holds all


def test_neighbours_over_several_levels_of_boxes(spark, monkeypatch):
    from plumbline.operators import vectors
    monkeypatch.setattr(vectors, "TOP_NODES", 2)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    few = lof(frame(spark, x), "id", k=5, block_rows=20).toPandas().set_index("row_key")["raw_score"].sort_index()
    one = lof(frame(spark, x), "id", k=5, block_rows=600).toPandas().set_index("row_key")["raw_score"].sort_index()
    assert np.allclose(few, one, atol=1e-3)


def test_blocks_that_are_all_near_each_other_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 12))
    x[400:440] = x[0]  # copies
    x[500:520] = np.round(x[500:520])
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    edges, met, tiles = {}, [], neighbours._in_tiles
    monkeypatch.setattr(neighbours, "_in_tiles", lambda *a: met.append(a[-1]) or tiles(*a))
    for partners in (10 ** 9, 1):
        monkeypatch.setattr(neighbours, "MANY_PARTNERS", partners)
        monkeypatch.setattr(neighbours, "TILE_COPIES", 3)
        met.clear()
        frame = neighbours.vector_frame(t, "id", vector_col="v")
        placed = neighbours.blocks(frame.groupBy("vec").agg(F.min("row_key").alias("first"), F.count("*").alias("copies")), 12, 40).persist()
        edges[partners] = {tuple(r) for r in neighbours.nearest(placed, 12, 8).join(
            placed.select("pos", "first"), "pos").select("first", "dist", "weight").collect()}
        assert met == ([] if partners > 1 else [6])  # 17 blocks, each near about all
    assert edges[1] == edges[10 ** 9]
    dist = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    assert max(d for i, d, _ in edges[1] if i == 7) == pytest.approx(np.sort(dist[7])[8])


def test_few_groups_where_few_blocks_are_near(spark, monkeypatch):
    met = []
    monkeypatch.setattr(neighbours, "work_parts", lambda n, *a: met.append(n) or 2)
    x = np.random.default_rng(5).uniform(size=(2000, 2))
    lof(frame(spark, x), "id", k=3, block_rows=20)
    assert met[1] <= 13 * 13  # 100 blocks, each near some, in 13 tiles
