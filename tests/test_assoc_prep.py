import math

import pytest
from pyspark.sql import functions as F

from tessera.functions.stats import chi2_sf, pearson_p
from tessera.operators import assoc, prep


def test_pvalues_against_tabulated():
    assert pearson_p(0.5, 10) == pytest.approx(0.14111, abs=1e-5)
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(10.0, 4) == pytest.approx(0.040428, abs=1e-6)


def test_yates_on_known_2x2(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "c1 string, c2 string")
    r = assoc.chi_square_pairs(df, ["c1", "c2"]).first()
    # expected 12, 18, 28, 42; |o - e| = 2 -> (1.5^2) * sum(1/e)
    chi = 2.25 * (1 / 12 + 1 / 18 + 1 / 28 + 1 / 42)
    assert r.chi2 == pytest.approx(chi)
    assert r.dof == 1 and r.cramers_v == pytest.approx(math.sqrt(chi / 100))


def test_zero_cells_counted(spark):
    rows = [("a", "x")] * 10 + [("b", "y")] * 10 + [("c", "x")] * 10
    r = assoc.chi_square_pairs(spark.createDataFrame(rows, "c1 string, c2 string"), ["c1", "c2"]).first()
    assert r.n_rows == 3 and r.n_cols == 2 and r.chi2 == pytest.approx(30.0)


def test_bh_matches_manual(spark):
    ps = [0.01, 0.04, 0.03, 0.2, 0.5]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "test_idx int, p_value double")
    out = {r.test_idx: r.p_adjusted for r in assoc.fdr_bh(df).collect()}
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    adj = [0.0] * m
    run = 1.0
    for rank in range(m, 0, -1):
        i = order[rank - 1]
        run = min(run, ps[i] * m / rank)
        adj[i] = run
    for i in range(m):
        assert out[i] == pytest.approx(adj[i])


def test_business_conflict_high(spark):
    t = spark.createDataFrame([("transit_time", "sla_flag", 0.8)], "feature1 string, feature2 string, correlation double")
    r = assoc.business_conflicts(t, assoc.expectations_frame(spark, "logistics")).first()
    assert r.conflict_severity == "high" and r.expected_relationship == "negative"


def test_split_sizes_disjoint_and_repeatable(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 3).cast("string"))
    a = prep.random_split(df, ["id"])
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"test": 150, "validation": 150, "train": 700}
    b = prep.random_split(df.repartition(17), ["id"])
    assert a.join(b, ["id", "split"]).count() == 1000
    s = prep.stratified_split(df, "y", ["id"])
    per = {(r.split, r.y): r["count"] for r in s.groupBy("split", "y").count().collect()}
    assert sum(v for (sp, _), v in per.items() if sp == "test") == 150
    assert all(abs(per[("test", y)] - 50) <= 1 for y in ("0", "1", "2"))


def test_time_split_boundaries(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("timestamp"))
    s = prep.time_split(df, "t", ["id"])
    mx = {r.split: r.mx for r in s.groupBy("split").agg(F.max("id").alias("mx")).collect()}
    assert mx == {"train": 69, "validation": 84, "test": 99}


def test_encoders_unseen_and_scaling(spark):
    train = spark.createDataFrame([(c, i) for i, c in enumerate("ABCABCABCA")], "category string, value int")
    p = prep.fit(train, cat_cols=["category"])
    val = spark.createDataFrame([("D", 1), ("A", 2)], "category string, value int")
    out = prep.transform(val, p).collect()
    d = [r for r in out if not (r.category_A or r.category_B or r.category_C)]
    assert len(d) == 1
    mean, std = p.scale_stats["value"]
    assert mean == pytest.approx(4.5) and std == pytest.approx(math.sqrt(8.25))


def test_target_encoder_formula(spark):
    rows = [("x", 1)] * 30 + [("x", 0)] * 10 + [("y", 1)]
    df = spark.createDataFrame(rows, "c string, t int")
    st, prior = prep.fit_target_encoder(df, "c", "t")
    enc = {r.value: r.enc for r in st.collect()}
    w = 1 / (1 + math.exp(-(40 - 20)))
    assert enc["x"] == pytest.approx(prior * (1 - w) + 0.75 * w)
    assert enc["y"] == pytest.approx(prior)
