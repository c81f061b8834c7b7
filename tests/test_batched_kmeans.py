"""Runs that share their passes equal runs on their own, and the measures equal plain ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loyaltide.operators import batched_kmeans as bk
from loyaltide.operators import segmentation as seg


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(4)
    centres = r.normal(0, 5, (4, 3))
    return np.concatenate([c + r.normal(0, 1.5, (60 + 20 * i, 3)) for i, c in enumerate(centres)])


@pytest.fixture(scope="module")
def vectors(spark, points):
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "customer_id bigint, x array<double>").repartition(5).select(
        "customer_id", array_to_vector("x").alias("vector")).cache()


@pytest.fixture(scope="module")
def rows(vectors):
    return bk.as_rows(vectors, "customer_id").cache()


def lloyd(points, centres, max_iter, tolerance=1e-4):
    """Plain iterations of one run."""
    for _ in range(max_iter):
        label = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.stack([points[label == j].mean(0) if (label == j).any() else centres[j]
                        for j in range(len(centres))])
        moved = np.sqrt(((new - centres) ** 2).sum(1)).max()
        centres = new
        if moved <= tolerance:
            break
    gap = ((points[:, None] - centres[None]) ** 2).sum(2)
    return centres, gap.min(1).sum(), np.bincount(gap.argmin(1), minlength=len(centres))


def test_shared_passes_equal_single_fits(rows, points):
    starts = bk.draw_starts(rows, [3, 4, 5], 6)
    runs = [c[:k] for k in (2, 4, 6) for c in starts]
    for start, got in zip(runs, bk.fit_runs(rows, runs, 30), strict=True):
        centres, cost, sizes = lloyd(points, start, 30)
        assert np.allclose(got.centres, centres) and got.cost == pytest.approx(cost)
        assert got.sizes.tolist() == sizes.tolist()
        alone, = bk.fit_runs(rows, [start], 30)
        assert np.allclose(alone.centres, got.centres)


def test_starts_are_rows_and_repeat(rows, points):
    starts = bk.draw_starts(rows, [1, 2], 5)
    assert np.array_equal(starts, bk.draw_starts(rows, [1, 2], 5))
    assert np.array_equal(starts[:1, :3], bk.draw_starts(rows, [1], 3))
    known = {tuple(p) for p in points}
    assert all(tuple(c) in known for s in starts for c in s)
    assert all(len({tuple(c) for c in s}) == 5 for s in starts)


def test_starts_follow_squared_distance(spark):
    """Of 99 rows at 0 and one far away, the second centre is always the other kind."""
    df = spark.createDataFrame([(i, [0.0 if i else 100.0]) for i in range(100)],
                               "key bigint, x array<double>")
    assert all(sorted(s[:, 0]) == [0.0, 100.0] for s in bk.draw_starts(df, range(8), 2))


def test_measures(vectors, rows, points):
    fits = [min(bk.fit_runs(rows, list(bk.draw_starts(rows, [s], 4)), 50), key=lambda r: r.cost)
            for s in (1, 9)]
    labelled = bk.label_rows(rows, fits).cache()
    found, = bk.spread_of(labelled, [1], [fits[1].sizes])
    out = fits[1].transform(vectors)
    assert found["silhouette"] == pytest.approx(
        ClusteringEvaluator(featuresCol="vector", predictionCol="segment_id").evaluate(out))
    plain = out.select("segment_id", *[F.col("x")[i].alias(f"x{i}") for i in range(3)]) \
        if "x" in out.columns else seg_rows(out)
    assert found["davies_bouldin"] == pytest.approx(
        seg.davies_bouldin(plain, ["x0", "x1", "x2"]).first()[0])
    both = labelled.select(F.col("labels")[0].alias("a"), F.col("labels")[1].alias("b"))
    assert bk.agreement(labelled, [(0, 1)])[0, 1] == pytest.approx(
        seg.adjusted_rand(both, "a", "b").first()[0])


def seg_rows(out):
    from pyspark.ml.functions import vector_to_array
    x = vector_to_array("vector")
    return out.select("segment_id", *[x[i].alias(f"x{i}") for i in range(3)])


def test_evaluate_k_counts_its_passes(vectors, monkeypatch):
    passes = []
    for name in ("measure",):
        real = getattr(bk, name)
        monkeypatch.setattr(bk, name, lambda *a, real=real: (passes.append(1), real(*a))[1])
    table = seg.evaluate_k(vectors, range(3, 6), seeds=(0, 1, 2), n_init=3, max_iter=20).collect()
    assert [r.k for r in table] == [3, 4, 5] and len(passes) <= 21
    costs = [r.inertie for r in table]
    assert costs == sorted(costs, reverse=True)
    assert all(-1 <= r.silhouette <= 1 and r.ari_min <= r.ari_moyen <= 1 for r in table)
    assert table[1].ari_min == pytest.approx(1.0)          # four groups were made


def test_empty_cluster_keeps_its_centre(rows):
    start = np.array([[0.0, 0.0, 0.0], [1e6, 1e6, 1e6]])
    fit, = bk.fit_runs(rows, [start], 10)
    assert fit.sizes[1] == 0 and np.array_equal(fit.centres[1], start[1])
