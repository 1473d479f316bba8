"""A staged run taken up again repeats no finished stage."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import quality
from tessera.plans import stages


def counted(calls, name, status="PASS", fail=None):
    def run(df):
        calls.append(name)
        if fail and fail.pop("now", None):
            raise RuntimeError("executor lost")
        return df.withColumn(name, F.lit(name)), df.sparkSession.createDataFrame([(name,)], "stage string"), status
    return run


def test_resume_after_a_failure(spark, tmp_path):
    df, calls, fail = spark.range(100).withColumn("v", F.col("id") % 7), [], {"now": True}
    plan = [("a", counted(calls, "a")), ("b", counted(calls, "b", "WARN")), ("c", counted(calls, "c", fail=fail)), ("d", counted(calls, "d"))]
    with pytest.raises(RuntimeError):
        stages.run_stages(df, plan, str(tmp_path / "run"))
    assert calls == ["a", "b", "c"]
    res = stages.run_stages(df.repartition(5), plan, str(tmp_path / "run"))  # other order, same rows
    assert calls == ["a", "b", "c", "c", "d"]
    assert [(r.name, r.status, r.rows, r.resumed) for r in res] == [("a", "PASS", 100, True), ("b", "WARN", 100, True), ("c", "PASS", 100, False), ("d", "PASS", 100, False)]
    assert res[-1].data.columns == ["id", "v", "a", "b", "c", "d"] and res[1].report.first().stage == "b"
    assert all(r.resumed for r in stages.run_stages(df, plan, str(tmp_path / "run")))
    assert calls == ["a", "b", "c", "c", "d"]


def test_changed_input_or_stage_runs_anew(spark, tmp_path):
    df, calls = spark.range(50).withColumn("v", F.col("id") % 7), []
    plan = [("a", counted(calls, "a")), ("b", counted(calls, "b")), ("c", counted(calls, "c"))]
    folder = str(tmp_path / "run")
    stages.run_stages(df, plan, folder)
    stages.run_stages(df.filter("id <> 3"), plan, folder)
    assert calls == ["a", "b", "c"] * 2
    stages.run_stages(df.filter("id <> 3"), [plan[0], ("other", counted(calls, "other")), plan[2]], folder)
    assert calls == ["a", "b", "c"] * 2 + ["other", "c"]
    twice = df.unionAll(df)
    assert stages._fingerprint(twice) != stages._fingerprint(df) and stages._fingerprint(twice) != stages._fingerprint(df.withColumn("v", F.lit(1)).unionAll(df))


def test_domain_and_ingest_gates(spark, tmp_path):
    ship = spark.createDataFrame([("o", "c", "s")], "order_id string, carrier string, status string")
    plan = [("domain", stages.domain_stage("logistics")), ("ingest", stages.ingest_stage(str(tmp_path))), ("schema", stages.schema_stage())]
    assert [(r.name, r.status) for r in stages.run_stages(ship, plan)] == [("domain", "WARN"), ("ingest", "OK"), ("schema", "OK")]
    assert [(r.name, r.status) for r in stages.run_stages(ship.select("carrier"), plan)] == [("domain", "STOP")]
    assert stages.ingest_stage(str(tmp_path))(ship.limit(0))[2] == "STOP"


def test_input_and_cleaned_rows_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf.assign(v=(pdf["id"] % 40).astype("int64"))

    def through(df):
        return df, df.sparkSession.createDataFrame([("x",)], "stage string"), "OK"

    df = spark.range(0, 300, 1, 2).mapInPandas(rows, "id long, v long").withColumn("id", F.col("id") % 150)
    plan = [("pass", through), ("ingest", stages.ingest_stage(str(tmp_path))), ("quality", stages.quality_stage([], ["id", "v"], dt.datetime(2030, 1, 1)))]
    folder = str(tmp_path / "run")
    res = stages.run_stages(df, plan, folder)
    kept = df.distinct().count()
    assert made.value == 600, made.value  # once in the run, once for the line above
    assert [(r.name, r.status, r.rows) for r in res] == [("pass", "OK", 300), ("ingest", "OK", 300), ("quality", "PASS", kept)]
    assert res[0].data.count() == 300 and res[2].data.count() == kept
    again = stages.run_stages(df, plan, folder)
    assert all(r.resumed for r in again) and [r.rows for r in again] == [300, 300, kept] and again[0].data.count() == 300


def test_quality_scans_do_not_repeat_the_fixes(spark):
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        for pdf in batches:
            made.add(len(pdf))
            yield pdf

    df = spark.range(0, 100, 1, 2).mapInPandas(rows, "id long").withColumn("d", F.timestamp_seconds("id"))
    out = quality.run_quality_control(df, ["id"], ["id"])
    before = made.value
    assert out["status"].first()["status"] == "PASS" and [out[k].count() for k in ("data", "missing", "dates", "keys")] == [100, 2, 1, 1]
    assert made.value == before
