import datetime as dt

import pytest

from tessera.operators import impute as imp
from tessera.operators import merge as mrg


def test_median_and_group_median(spark):
    df = spark.createDataFrame([("A", 10.0), ("A", None), ("A", 50.0), ("B", 30.0), ("B", None)],
                               "group string, value double")
    out = imp.impute_group_median(df, "value", "group").collect()
    assert sorted(r.value for r in out) == [10.0, 30.0, 30.0, 30.0, 50.0]
    m = imp.impute_median(spark.createDataFrame([(1.0,), (2.0,), (None,), (4.0,), (5.0,)], "value double"), ["value"])
    assert sorted(r.value for r in m.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_decisions_dates_flag_only(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (None,), (dt.datetime(2024, 1, 3),)], "date_col timestamp_ntz")
    d = imp.decide_methods(df).first()
    assert d.method == "flag_only"
    out = imp.apply_decisions(df, [d])
    assert sorted(r.date_col_missing for r in out.collect()) == [0, 0, 1]


def test_psi_zero_for_equal_tables_and_ks(spark):
    import numpy as np
    vals = [float(v) for v in np.random.default_rng(42).normal(10, 2, 80)] + [None] * 20
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    assert imp.psi(df, "value", df, "value").first().psi == pytest.approx(0.0)
    assert imp.ks_statistic(df, "value", df, "value").first().ks == pytest.approx(0.0)
    filled = imp.impute_median(df, ["value"])
    ks = imp.ks_statistic(df, "value", filled, "value").first().ks
    a = np.array([v for v in vals if v is not None])
    b = np.array([v if v is not None else np.median(a) for v in vals])
    grid = np.sort(np.concatenate([a, b]))
    f1 = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    f2 = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    assert ks == pytest.approx(np.abs(f1 - f2).max())


def test_mode_and_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",), (None,)], "c string")
    assert sorted(r.c for r in imp.impute_mode(df, "c").collect()) == ["a", "a", "a", "b", "b"]
    assert "Unknown" in [r.c for r in imp.impute_unknown(df, "c").collect()]


def test_merge_duplicate_stop_and_keep_latest(spark):
    t = dt.datetime(2024, 1, 1)
    main = spark.createDataFrame([(1, t, 10), (1, t + dt.timedelta(hours=1), 20), (2, t, 30), (3, t, 40), (4, t, 50)],
                                 "order_id int, timestamp timestamp_ntz, value int")
    res = mrg.merge_tables(main, [])
    assert res.status == "STOP"  # 20 % duplicate keys
    rows = [(i // 1 if i < 95 else i - 95, t + dt.timedelta(minutes=i), float(i)) for i in range(100)]
    dup5 = spark.createDataFrame(rows, "order_id int, timestamp timestamp_ntz, value double")
    res = mrg.merge_tables(dup5, [])
    assert res.status == "WARN"
    assert res.data.count() == 95
    kept = {r.order_id: r.value for r in res.data.collect()}
    assert kept[0] == 95.0


def test_merge_orphans_quarantine(spark):
    main = spark.createDataFrame([(i, i % 7) for i in range(100)], "order_id int, x int")
    right = spark.createDataFrame([(i, f"n{i}") for i in range(95)], "order_id int, x string")
    res = mrg.merge_tables(main, [("names", right, None)])
    assert res.status == "WARN"
    assert res.data.count() == 95 and res.orphans["names"].count() == 5
    assert "x_names" in res.data.columns
