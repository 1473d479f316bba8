"""Structured Streaming monitors (MON-3, MON-4).

* Event-time tumbling windows with a watermark; state per window is only
  the per-bin counts (PSI) or a few sums (KPIs), so it stays small and is
  dropped once the watermark passes.
* Update output mode into ``foreachBatch``: each micro-batch's updated
  window rows are written under ``batch_id=<n>`` (overwrite: a replayed
  batch after a failure rewrites the same folder, so the sink is
  idempotent). ``latest`` reads the newest value per window key.
* Everything lives under the cluster's shared checkpoint folder; the
  streaming checkpoint makes a restarted query resume where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.columns import as_utc_instant, utc_instant_to_ntz
from tessera.operators.impute import bin_index
from tessera.sources.landing import scratch_path


def file_stream(spark: SparkSession, directory: str, schema, glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(directory)


def run_update_sink(stream: DataFrame, out_path: str, checkpoint: str,
                    processing_time: str | None = None, wait: bool = True):
    """Update mode, each micro-batch's updated rows written to
    out_path/batch_id=<n>. By default runs over what is available
    (availableNow) and returns the path; with ``processing_time`` (e.g.
    "1 minute") it keeps running and the StreamingQuery is returned."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out_path}/batch_id={batch_id}")

    w = (stream.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    q = w.start()
    if processing_time and not wait:
        return q
    q.awaitTermination()
    return out_path


def latest(spark: SparkSession, out_path: str, keys: list[str]) -> DataFrame:
    """Newest row per key across micro-batches (the last update wins)."""
    df = spark.read.parquet(out_path)
    vals = [c for c in df.columns if c not in keys and c != "batch_id"]
    best = F.max_by(F.struct(*[F.col(c) for c in vals]), F.col("batch_id"))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*")


# ------------------------------------------------------------------ MON-3
def baseline_bins(baseline: DataFrame, col: str, bins: int = 10) -> tuple[list[float], list[float]]:
    """Decile edges of the baseline and its share per bin (all numbers small)."""
    from tessera.operators.impute import decile_edges
    edges = decile_edges(baseline, col, bins)
    x = F.col(col).cast("double")
    row = baseline.filter(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(bin_index(x, edges) == i).alias(f"b{i}") for i in range(len(edges) - 1)]).first()
    shares = [row[f"b{i}"] / row["n"] for i in range(len(edges) - 1)]
    return edges, shares


def windowed_bin_counts(stream: DataFrame, ts_col: str, value_col: str, edges: list[float],
                        window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per event-time window: non-null values, and counts per baseline bin."""
    ts = as_utc_instant(F.col(ts_col))
    x = F.col(value_col).cast("double")
    s = stream.select(ts.alias("_ts"), x.alias("_x")).withWatermark("_ts", watermark)
    return (s.filter(F.col("_x").isNotNull())
             .groupBy(F.window("_ts", window).alias("w"), bin_index(F.col("_x"), edges).alias("bin"))
             .agg(F.count(F.lit(1)).alias("n"))
             .select(utc_instant_to_ntz(F.col("w.start")).alias("window_start"), "bin", "n"))


def window_psi(counts: DataFrame, baseline_shares: list[float]) -> DataFrame:
    """PSI per window from (window_start, bin, n); out-of-range values (null
    bin) count in the window total only; zero share -> 0.0001."""
    tot = counts.groupBy("window_start").agg(F.sum("n").alias("total"))
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(s)).alias("old"))
                     for i, s in enumerate(baseline_shares)])
    grid = tot.select("window_start", "total", F.explode(bins).alias("b")).select("window_start", "total", "b.*")
    j = grid.join(counts.filter(F.col("bin").isNotNull()), ["window_start", "bin"], "left")
    new = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    new = F.when(new == 0, F.lit(0.0001)).otherwise(new)
    old = F.when(F.col("old") == 0, F.lit(0.0001)).otherwise(F.col("old"))
    return j.groupBy("window_start").agg(F.sum((new - old) * F.log(new / old)).alias("psi"),
                                         F.first("total").alias("n"))


def drift_stream(spark: SparkSession, directory: str, schema, glob: str, ts_col: str, value_col: str,
                 baseline: DataFrame, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    edges, shares = baseline_bins(baseline, value_col)
    stream = file_stream(spark, directory, schema, glob)
    counts = windowed_bin_counts(stream, ts_col, value_col, edges, window, watermark)
    out = run_update_sink(counts, scratch_path(spark, "drift-out"), scratch_path(spark, "drift-ckpt"))
    return window_psi(latest(spark, out, ["window_start", "bin"]), shares)


# ------------------------------------------------------------------ MON-4
def windowed_kpis(stream: DataFrame, ts_col: str, value_col: str, flag_expr: F.Column,
                  window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Per window: events, mean value, and the share (x 100) of a flag."""
    ts = as_utc_instant(F.col(ts_col))
    s = stream.select(ts.alias("_ts"), F.col(value_col).cast("double").alias("_v"),
                      flag_expr.cast("int").alias("_f")).withWatermark("_ts", watermark)
    return (s.groupBy(F.window("_ts", window).alias("w"))
             .agg(F.count(F.lit(1)).alias("events"), F.sum("_v").alias("value_sum"),
                  F.count("_v").alias("value_n"), F.sum("_f").alias("flag_n"))
             .select(utc_instant_to_ntz(F.col("w.start")).alias("window_start"), "events", "value_sum",
                     "value_n", "flag_n"))


def kpi_stream(spark: SparkSession, directory: str, schema, glob: str, ts_col: str, value_col: str,
               flag_expr: F.Column, window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    stream = file_stream(spark, directory, schema, glob)
    agg = windowed_kpis(stream, ts_col, value_col, flag_expr, window, watermark)
    out = run_update_sink(agg, scratch_path(spark, "kpi-out"), scratch_path(spark, "kpi-ckpt"))
    res = latest(spark, out, ["window_start"])
    return res.select("window_start", "events", (F.col("value_sum") / F.col("value_n")).alias("mean_value"),
                      (F.col("flag_n") / F.col("events") * 100).alias("flag_pct"))

