"""Cases re-created from the reference's own test inputs (FIXTURES.md)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import prep, quality as qc, schema as sch


def test_qc_dates_descending_warns(spark):
    base = dt.datetime(2024, 1, 1)
    days = [base - dt.timedelta(days=i) for i in range(1000)]
    days[10], days[500] = days[500], days[10]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, date_field timestamp_ntz")
    r = qc.date_inversions(df, ["id"]).first()
    assert r.status == "WARN" and r.inversions > 900


def test_typing_bad_dates_and_numbers(spark):
    rows = [(1, "2024-01-01", "1.5"), (2, "not a date", "2.5"), (3, "2024-01-03", "x"),
            (4, "bad", "4.0"), (5, "2024-01-05", "5%")]
    df = spark.createDataFrame(rows, "id int, bad_date string, bad_numeric string")
    plan = {r.column: r for r in sch.infer_plan(df).collect()}
    assert plan["id"].target_type == "string"           # name contains 'id'
    assert plan["bad_date"].target_type == "timestamp"  # name says date; failures become null
    assert plan["bad_date"].failures == 2 and plan["bad_date"].warning is not None
    assert plan["bad_numeric"].target_type == "string"  # 80 % numeric < 98 %, 5 distinct of 5 rows


def test_target_encoding_chosen_for_large_high_cardinality(spark):
    df = spark.range(60000).select((F.col("id") % 100).cast("string").alias("category"),
                                   (F.col("id") % 2).cast("int").alias("target"))
    p = prep.fit_encoders(df, target="target", cat_cols=["category"])
    assert p.methods["category"][0] == "Target_KFold"
    small = df.limit(1000)
    assert prep.fit_encoders(small, target="target", cat_cols=["category"]).methods["category"][0] == "Ordinal"


def test_key_missing_column_stops(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert qc.key_check(df, ["missing"]).first().status == "STOP"
