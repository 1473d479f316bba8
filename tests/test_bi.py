import pytest
from pyspark.sql import functions as F

from tessera.operators import bi


def test_range_filter_mean_by_dimension(spark):
    df = spark.createDataFrame([("DHL", 30, "N"), ("DHL", 50, "N"), ("Aramex", 25, "S"), ("Aramex", 41, "S")],
                               "carrier string, transit_time int, region string")
    out = {r[0]: r[1] for r in bi.aggregate(df, "transit_time", "mean", {"transit_time": {"range": [25, 40]}},
                                            dimension="carrier").collect()}
    assert out == {"DHL": 30.0, "Aramex": 25.0}


def test_tail_quantiles_linear(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("x"))
    r = bi.aggregate(df, "x", ["p90", "p95"]).first()
    assert r["p90_x"] == pytest.approx(89.1)
    assert r["p95_x"] == pytest.approx(94.05)


def test_filters_in_like_and_unknown_column(spark):
    df = spark.createDataFrame([("a", "urgent order"), ("b", None), ("c", "normal")], "k string, note string")
    out = bi.apply_filters(df, {"note": {"like": "urg"}, "missing": 1}).collect()
    assert [r.k for r in out] == ["a"]
    assert bi.apply_filters(df, {"k": {"in": ["a", "c"]}}).count() == 2


def test_text_metric_only_counts(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "s string")
    assert bi.aggregate(df, "s", "count").first()[0] == 2
    with pytest.raises(ValueError):
        bi.aggregate(df, "s", "mean")


def test_column_resolution():
    from tessera.columns import resolve_column
    cols = ["transit_time", "Carrier-Name"]
    assert resolve_column(cols, "TRANSIT_TIME") == "transit_time"
    assert resolve_column(cols, "carrier_name") == "Carrier-Name"
    assert resolve_column(["transittime"], "transit_time") == "transittime"
    assert resolve_column(cols, "transittime") is None


def test_trend_daily_mean(spark):
    import datetime as dt
    rows = [(dt.datetime(2024, 1, 1) + dt.timedelta(days=i), 100 + 2 * i) for i in range(30)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, metric int")
    out = bi.trend(df, "metric", "D").orderBy("period").collect()
    assert len(out) == 30 and out[0][1] == 100.0 and out[-1][1] == 158.0


def test_group_view(spark):
    g = spark.createDataFrame([(f"g{i}", i) for i in range(1, 70)], "k string, v int")
    out = bi.group_view(g, "k", "v", top=10, high=50, low=5).collect()
    top = [r for r in out if r.section == "top"]
    assert len(top) == 10 and top[0].value == 69
    assert [r.value for r in out if r.section == "low"] == [5, 4, 3]
