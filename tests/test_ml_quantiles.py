import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantiles, grouped_exact_quantiles
from tessera.operators import explore, impute_models, kpi, select
from tessera.sources import landing


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.integers(0, 50, 997).astype(float)
    df = spark.createDataFrame([(float(v), "g" + str(i % 3)) for i, v in enumerate(vals)], "x double, g string")
    got = exact_quantiles(df.repartition(7), ["x"], [0.0, 0.1, 0.5, 0.9, 1.0])["x"]
    assert got == pytest.approx(list(np.quantile(vals, [0.0, 0.1, 0.5, 0.9, 1.0])))
    grp = {r.g: (r.med, r.p9) for r in grouped_exact_quantiles(df, ["g"], "x", [0.5, 0.9], ["med", "p9"]).collect()}
    for k in range(3):
        sub = vals[k::3]
        assert grp[f"g{k}"] == pytest.approx((np.quantile(sub, 0.5), np.quantile(sub, 0.9)))


@pytest.mark.parametrize("fetch,buckets,passes", [(200_000, 4096, 5), (0, 16, 20), (3, 8, 3), (0, 4, 1)])
def test_ranks_by_histogram_refinement(spark, monkeypatch, fetch, buckets, passes):
    from tessera.functions import quantiles
    for name, v in (("FETCH", fetch), ("BUCKETS", buckets), ("PASSES", passes)):
        monkeypatch.setattr(quantiles, name, v)
    rng = np.random.default_rng(9)
    a = np.concatenate([rng.normal(size=200), np.repeat(7.25, 150), [1e300, -1e300, 1e-300, 0.0, -0.0, np.inf, -np.inf, np.inf]])
    b = np.concatenate([np.full(300, np.nan), rng.integers(-3, 3, 50).astype(float), np.full(8, 1e15)])
    df = spark.createDataFrame([(float(x), None if np.isnan(y) else float(y), int(h)) for x, y, h in
                                zip(a, b, rng.integers(-2**63, 2**63 - 1, len(a)))], "a double, b double, h long").repartition(3)
    probs = [0.0, 0.03, 0.5, 0.97, 0.5001]
    got = exact_quantiles(df, ["a", "b"], probs)
    fine = np.sort(a)[2:-3]
    inner = df.filter(F.col("a").between(float(fine[0]), float(fine[-1])))
    assert exact_quantiles(inner, ["a"], probs)["a"] == pytest.approx(list(np.quantile(fine, probs)))
    assert got["a"][0] == -np.inf and got["a"][2] == pytest.approx(np.quantile(np.clip(a, -1e300, 1e300), 0.5))
    assert got["b"] == pytest.approx(list(np.nanquantile(b, probs)))
    h = np.sort([r.h for r in df.collect()])
    found, rows = quantiles.select_ranks(df, [F.col("h")], lambda i, n: [0, 5, n // 2, n - 1, n], "long")
    assert rows == [len(h)] and found == {(0, r): (h[r], r, 1) for r in (0, 5, len(h) // 2, len(h) - 1)}


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, float("nan"))], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.5]) == {"a": [None], "b": [None]}
    assert exact_quantiles(df.limit(0), ["a"], [0.1, 0.9]) == {"a": [None, None]}


def test_hot_group_quantile(spark):
    # one group holds most rows; result still exact
    rows = [("hot", float(i)) for i in range(3000)] + [("cold", 1.0), ("cold", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r.g: r.m for r in grouped_exact_quantiles(df, ["g"], "x", [0.5], ["m"], num_partitions=6).collect()}
    assert out == {"hot": 1499.5, "cold": 2.0}


def test_kmeans_finds_planted_clusters(spark):
    rng = np.random.default_rng(0)
    centers = np.array([[0, 0], [10, 10], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.3, size=(60, 2)) for c in centers])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "a double, b double")
    scores, sizes = explore.kmeans_best_k(explore.feature_matrix(df, ["a", "b"]))
    best = max(scores.collect(), key=lambda r: r.silhouette)
    assert best.k == 3
    assert sorted(r["size"] for r in sizes.collect()) == [60, 60, 60]


def test_isolation_forest_share_and_outlier(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(1000, 3))
    pts[0] = [25, 25, 25]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "id long, a double, b double, c double")
    fm = explore.feature_matrix(df, ["a", "b", "c"], keep=["id"])
    flags = explore.isolation_forest(fm, ["id"], n_trees=50)
    share = flags.agg(F.avg(F.col("anomaly_flag").cast("double"))).first()[0]
    assert 0.04 <= share <= 0.06
    assert flags.filter("id = 0").first().anomaly_flag


def test_vif_against_direct_solve(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 3))
    X[:, 2] = X[:, 0] * 0.9 + rng.normal(scale=0.2, size=300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double")
    got = {r.feature: r.vif for r in select.vif(df, ["a", "b", "c"]).collect()}
    for j, name in enumerate("abc"):
        y, others = X[:, j], np.delete(X, j, axis=1)
        beta, *_ = np.linalg.lstsq(others, y, rcond=None)
        r2 = 1 - ((y - others @ beta) ** 2).sum() / (y ** 2).sum()  # no intercept: uncentered
        assert got[name] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_knn_exact_small(spark):
    rows = [(0, 1.0, 1.0), (1, 2.0, 2.0), (2, 3.0, 3.0), (3, 10.0, 10.0), (4, 1.1, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = {r.id: r.b for r in impute_models.knn_impute(df, ["a", "b"], k=2).collect()}
    assert out[4] == pytest.approx(1.5)  # nearest by a: ids 0 and 1


def test_side_tables_and_kpi_adoption(spark):
    df = spark.createDataFrame([("A1", "good"), ("A2", "late")], "AWB_NO string, customer_feedback string")
    landing.register_side_table(df, "tessera_test_feedback", "AWB_NO")
    reg = {r.table: r.key_column for r in landing.side_tables(spark).collect()}
    assert reg.get("tessera_test_feedback") == "AWB_NO"
    f = {"type": "count", "aggregation": {"aggregation": "count"}}
    kpi.adopt(spark, "tessera_test_kpis", "rows", f)
    assert kpi.adopted_formulas(spark, "tessera_test_kpis")["rows"] == f
    spark.sql("DROP TABLE IF EXISTS tessera_test_feedback")
    spark.sql("DROP TABLE IF EXISTS tessera_test_kpis")


def test_stratified_split_many_strata_and_nulls(spark):
    from tessera.operators.prep import stratified_split
    df = spark.range(2000).selectExpr("id", "IF(id % 50 = 0, NULL, id * id % 37) AS t")
    n = {r.split: r["count"] for r in stratified_split(df, "t", ["id"]).groupBy("split").count().collect()}
    assert n == {"test": 300, "validation": 300, "train": 1400}
    shares = stratified_split(df, "t", ["id"]).selectExpr("t", "CAST(split = 'test' AS INT) AS x").groupBy("t").agg({"x": "avg", "*": "count"})
    assert all(abs(r["avg(x)"] - 0.15) <= 1 / r["count(1)"] for r in shares.collect())
    assert stratified_split(df.limit(0), "t", ["id"]).count() == 0


def test_date_look_from_all_rows(spark):
    from tessera.operators.schema import infer_plan
    # five date-like values first, then text; and the other way round
    df = spark.range(100).selectExpr(
        "IF(id < 5, '2024-01-02', concat('row-', id)) AS mostly_text",
        "IF(id < 5, concat('row-', id), '2024-01-02') AS mostly_days")
    target = {r.column: r.target_type for r in infer_plan(df).collect()}
    assert target == {"mostly_text": "string", "mostly_days": "timestamp"}


def test_forest_grows_below_depth_five(spark):
    df = spark.createDataFrame([(float(i % 32), float(i // 32 % 2), 100.0 * (i % 32) + i // 32 % 2) for i in range(512)], "x double, z double, y double")
    got = select.forest_importance(df, ["x", "z"], "y", n_trees=5)
    assert got == select.forest_importance(df, ["x", "z"], "y", n_trees=5, max_depth=30)
    assert got != select.forest_importance(df, ["x", "z"], "y", n_trees=5, max_depth=5)
