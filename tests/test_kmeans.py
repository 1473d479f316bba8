"""Stacked k-means against Spark ML's and plain Lloyd steps."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.operators import kmeans


def frame(spark, X):
    return spark.createDataFrame([(list(map(float, r)),) for r in X], "x array<double>").select(array_to_vector("x").alias("features")).repartition(3)


def blobs(rng, centres, n):
    return np.concatenate([c + rng.normal(scale=0.4, size=(n, len(c))) for c in np.array(centres, float)])


def test_cost_and_silhouette_as_good_as_ml(spark):
    X = blobs(np.random.default_rng(1), [[0, 0, 0], [4, 0, 1], [0, 5, 2], [5, 5, 0], [9, 1, 3]], 80)
    df = frame(spark, X)
    for m in kmeans.fit_many(df, [2, 4, 5], 6, 42, 300):
        ml = min((KMeans(k=m.k, seed=s, maxIter=300).fit(df) for s in range(6)), key=lambda x: x.summary.trainingCost)
        assert m.cost <= ml.summary.trainingCost * 1.001 and m.sizes.sum() == len(X)
        ev = ClusteringEvaluator()
        if m.cost == pytest.approx(ml.summary.trainingCost, rel=1e-6):
            assert m.silhouette == pytest.approx(ev.evaluate(ml.transform(df)), abs=1e-9)


def test_steps_equal_plain_lloyd(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(500, 2))
    first = [X[:3].copy(), X[10:15].copy()]
    packs = kmeans._packs(frame(spark, X), "features", f"{kmeans.ensure_checkpoint_dir(spark)}/t-{rng.integers(1 << 60)}")
    got = kmeans._lloyd(packs, 2, first, 4)
    for C, g in zip(first, got):
        for _ in range(4):
            at = ((X[:, None] - C) ** 2).sum(2).argmin(1)
            C = np.stack([X[at == j].mean(0) for j in range(len(C))])
        assert np.allclose(C, g)


def test_repeated_rows_and_fewer_points_than_k(spark):
    df = frame(spark, np.repeat([[0.0, 0.0], [1.0, 1.0]], 30, axis=0))
    models = kmeans.fit_many(df, [2, 4], 3, 1, 50)
    assert models[0].cost == pytest.approx(0) and models[0].silhouette == pytest.approx(1) and models[1].sizes.sum() == 60
    one = kmeans.fit_many(frame(spark, np.ones((20, 2))), [2], 2, 1, 10)[0]
    assert one.cost == pytest.approx(0) and one.silhouette == 0


def test_packs_are_small_and_dealt_evenly(spark):
    df = spark.range(0, 40_000, 1, 2).select(array_to_vector(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("features"))
    packs = kmeans._packs(df, "features", f"{kmeans.ensure_checkpoint_dir(spark)}/t-even")
    rows = [r["n"] for r in packs.groupBy(F.spark_partition_id()).agg(F.sum("n").alias("n")).collect()]
    assert sum(rows) == 40_000 and len(rows) == 4 and max(rows) < 1.3 * 10_000, rows
    ids = [i for r in packs.select("base", "n").collect() for i in range(r["base"], r["base"] + r["n"])]
    assert len(set(ids)) == 40_000
    packs.unpersist()


def test_nearest_takes_the_first_of_equal_centres():
    rng = np.random.default_rng(4)
    X, C, edge = rng.normal(size=(200, 3)), rng.normal(size=(9, 3)), np.array([0, 2, 5, 9])
    C[8] = C[6]
    got = kmeans._nearest(X, C, edge)
    for s, (a, b) in enumerate(zip(edge, edge[1:])):
        assert (got[s] == a + ((X[:, None] - C[a:b]) ** 2).sum(2).argmin(1)).all() and 8 not in got[s]
