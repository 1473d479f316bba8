from pyspark.sql import functions as F

from tessera.plans.order import prefix_sums, with_row_index

from .conftest import SF


def test_row_index_equals_global_row_number(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("k"))
    idx = with_row_index(df.repartition(9), ["k"], "i", num_partitions=6)
    assert all(r.k == r.i for r in idx.collect())


def test_prefix_sums(spark):
    df = spark.range(1, 101).select(F.col("id").alias("v"), F.lit(1).alias("c"))
    out = prefix_sums(df, ["v"], ["c"], num_partitions=5).collect()
    assert all(r.cum_c == r.v for r in out)


def test_entry_and_registry(spark):
    import __spark_entry__ as e
    out = e.entry(spark)
    assert out.count() > 0
    qs, orc = e.queries(), e.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 100


def test_stream_kpis_equal_batch(spark):
    from tessera.plans.registry import load
    from tessera.streaming.monitors import kpi_stream
    ev = load(spark, SF, "events")
    flag = F.col("event_type") == "purchase"
    s = kpi_stream(spark, SF, ev.schema, "events.parquet", "ts", "value", flag)
    b = (ev.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("window_start"))
           .agg(F.count(F.lit(1)).alias("events"), F.avg("value").alias("mean_value")))
    got = {r.window_start: (r.events, round(r.mean_value, 9)) for r in s.collect()}
    exp = {r.window_start: (r.events, round(r.mean_value, 9)) for r in b.collect()}
    assert got == exp
