import pytest

from tessera.operators import kpi, signals


def test_domain_kpis_and_absent_columns(spark):
    df = spark.createDataFrame([(1, 24), (1, 30), (1, 36), (0, 60), (0, 72)], "sla_flag int, transit_time int")
    r = kpi.compute_kpis(df, "logistics").first()
    assert r.sla_pct == 60.0 and r.avg_transit_h == 44.4 and r.total_shipments == 5
    assert r.rto_pct is None


def test_ratio_formula_and_format(spark):
    df = spark.createDataFrame([("Delivered", 1, 10), ("Delivered", 1, 20), ("Delivered", 0, 30), ("Returned", 0, 40)],
                               "status string, sla_flag int, transit_time int")
    f = {"delivered": {"type": "ratio", "multiplier": 100,
                       "numerator": {"aggregation": "count", "filter": {"column": "status", "operator": "equals",
                                                                        "value": "Delivered"}},
                       "denominator": {"aggregation": "count"}}}
    r = kpi.evaluate_formulas(df, f).first()
    assert r.value == 75.0 and r.formatted == "75.00%" and r.status == "pass"


def test_not_equals_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "s string")
    f = {"k": {"type": "count", "aggregation": {"aggregation": "count",
                                                "filter": {"column": "s", "operator": "not_equals", "value": "a"}}}}
    assert kpi.evaluate_formulas(df, f).first().value == 2.0


def test_zero_denominator_guards(spark):
    df = spark.createDataFrame([(1,)], "x int")
    base = {"numerator": {"aggregation": "count"},
            "denominator": {"aggregation": "count", "filter": {"column": "x", "operator": "equals", "value": 9}}}
    out = {r.kpi: r for r in kpi.evaluate_formulas(df, {
        "clamp": {"type": "ratio", **base}, "skip": {"type": "ratio", "guard_rail": "skip_on_zero", **base}}).collect()}
    assert out["clamp"].value == 0.0 and out["clamp"].status == "warn"
    assert out["skip"].value is None and out["skip"].status == "fail"


def test_bias_corrected_shape_matches_definition(spark):
    import numpy as np
    xs = [float(v) for v in np.random.default_rng(42).exponential(size=200)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    r = {row.metric: row.value for row in signals.shape(df, ["x"]).collect()}
    a = np.array(xs)
    n = len(a)
    m2, m3, m4 = ((a - a.mean()) ** 2).mean(), ((a - a.mean()) ** 3).mean(), ((a - a.mean()) ** 4).mean()
    g1, g2 = m3 / m2 ** 1.5, m4 / m2 ** 2 - 3
    assert r["skew"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), rel=1e-9)
    assert r["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6), rel=1e-9)


def test_outliers_and_trend(spark):
    import datetime as dt
    vals = [10.0] * 95 + [100.0, 110.0, 120.0, 130.0, 140.0]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    r = signals.outlier_pct_iqr(df).first()
    assert r.value == pytest.approx(5.0)
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100.0 + 2 * i) for i in range(30)]
    t = spark.createDataFrame(rows, "date timestamp_ntz, metric double")
    out = {x.metric: x.value for x in signals.trend_slope(t, "metric").collect()}
    assert out["slope_norm_pct"] == pytest.approx(2 / 129 * 100)


def test_quality_score_bounds(spark):
    df = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    r = signals.quality_score(df).first()
    assert r.duplicate_rate == 50.0 and r.missing_rate == 50.0 and r.quality_score == 60.0
