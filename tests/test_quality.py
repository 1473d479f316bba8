import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import quality as qc


def test_missing_threshold_is_strict(spark):
    # exactly 20 % missing is not over the threshold
    df = spark.createDataFrame([(i, None if i < 2 else 1.0, None if i < 3 else "x") for i in range(10)],
                               "id int, age double, name string")
    out = {r.column: (r.missing_pct, r.status) for r in qc.missing_scan(df).collect()}
    assert out["age"] == (0.2, "PASS")
    assert out["name"] == (0.3, "WARN")


def test_future_dates_share_of_all_rows(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [(1, now - dt.timedelta(days=1)), (2, now + dt.timedelta(days=1)), (3, now + dt.timedelta(days=2)),
            (4, None), (5, now)]
    df = spark.createDataFrame(rows, "id int, d timestamp_ntz")
    r = qc.future_dates(df, now).first()
    assert r.future_dates == 2 and r.future_pct == 0.4


def test_date_inversions_match_global_lag(spark):
    ev = spark.range(1000).select(F.col("id"), ((F.col("id") * 7919) % 1000).cast("double").alias("v"))
    ev = ev.withColumn("v", F.when(F.col("id") % 13 == 0, None).otherwise(F.col("v")))
    w = Window.orderBy("id")
    nn = ev.filter(F.col("v").isNotNull())
    expected = nn.withColumn("p", F.lag("v").over(w)).filter(F.col("v") < F.col("p")).count()
    for parts in (1, 7, 17):
        r = qc.date_inversions(ev.repartition(parts), ["id"], ["v"], num_partitions=parts).first()
        assert r.inversions == expected
        assert r.non_null == nn.count()


def test_key_check_duplicates_and_nulls(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "id int, value int")
    r = qc.key_check(df, ["id", "nope"]).collect()
    d = {x.key: x for x in r}
    assert d["id"].duplicates == 7 and d["id"].status == "STOP"
    assert d["nope"].status == "STOP"
    nulls = spark.createDataFrame([(None if i < 5 else float(i), i) for i in range(10)], "id double, value int")
    n = qc.key_check(nulls, ["id"]).first()
    assert n.nulls == 5 and n.duplicates == 4


def test_fixes_and_status(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (2, "b")], "x int, y string")
    clean, _ = qc.auto_fix(df)
    assert clean.count() == 2
    st = qc.overall_status(qc.missing_scan(clean), qc.key_check(clean, ["x"])).first().status
    assert st == "PASS"
