"""Empty frames, all-null columns, large tables and separators."""

import datetime as dt

from tessera.columns import resolve_column
from tessera.operators import assoc, dictionary, impute, merge, monitor, quality, select
from tessera.sources import readers

EMPTY = "k int, d timestamp_ntz"


def test_reports_over_an_empty_frame(spark):
    df = spark.createDataFrame([], EMPTY)
    assert quality.future_dates(df, dt.datetime(2024, 1, 1)).first()["future_pct"] is None
    assert quality.key_check(df, ["k"]).first()["status"] == "PASS"
    assert impute.completeness(df).first()[0] is None
    assert dictionary.feature_dictionary(df).count() == 2


def test_drift_with_an_all_null_column(spark):
    base = spark.createDataFrame([(float(i),) for i in range(50)], "x double")
    cur = spark.createDataFrame([(None,)] * 20, "x double")
    assert monitor.drift_check(base, cur).count() == 1


def test_empty_right_table_is_skipped(spark):
    main = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    out = merge.merge_tables(main, [("t", spark.createDataFrame([], "k int, w string"), "k")])
    assert out.status == "PASS" and out.data.columns == ["k", "v"] and out.data.count() == 2


def test_chi_square_beyond_any_grid(spark):
    rows = [(f"a{i % 150}", f"b{(i * 7) % 149}") for i in range(3000)]
    out = assoc.chi_square_pairs(spark.createDataFrame(rows, "a string, b string"), with_p=False).collect()
    assert len(out) == 1 and out[0]["dof"] == 149 * 148
    n, ra, cb, o = len(rows), {}, {}, {}
    for a, b in rows:
        ra[a], cb[b], o[a, b] = ra.get(a, 0) + 1, cb.get(b, 0) + 1, o.get((a, b), 0) + 1
    want = sum((o.get((a, b), 0) - ra[a] * cb[b] / n) ** 2 / (ra[a] * cb[b] / n) for a in ra for b in cb)
    assert abs(out[0]["chi2"] - want) < 1e-6 * want


def test_csv_separator_and_rejects(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1;"a;b";x\n2;c;y;extra\n3;"d ""q"" ;e"\n')
    good, bad = readers.read_csv_tolerant(spark, str(tmp_path), ";", ["k", "v", "w"])
    assert bad.collect()[0]["raw_line"] == "2;c;y;extra" and bad.count() == 1
    assert sorted(r["k"] for r in good.select("k").collect()) == ["1", "3"] and good.count() == 2
    counts = {r["reason"]: r["rows"] for r in readers.repair_csv(spark, str(tmp_path), ";", ["k", "v", "w"])[1].collect()}
    assert counts == {"ok": 1, "truncated": 1, "padded": 1}


def test_names():
    assert dictionary.clean_names(["a", "A", "a_1", "%%"]) == ["a", "a_1", "a_1_1", "feature"]
    assert dictionary.describe_name("late_rate-%") == "Late Rate Percent"
    assert resolve_column(["a-b_c"], "A_B-C") == "a-b_c" and resolve_column(["ab"], "a-b") == "ab"


def test_merged_selection_order():
    imp = {"a": 0.5, "b": 0.3, "c": 0.1, "d": 0.1}
    assert select.merge_selections(imp, ["c", "z", "b"], 4, ["d"]) == ["b", "c", "z", "a"]
