"""Global row order without moving the table into one task.

``Window.orderBy`` with no ``partitionBy`` sends every row to a single task.
Instead we range-partition on the order key, sort inside each partition, and
pin the result with a reliable checkpoint (so partition ids and positions
survive a lost executor). Only per-partition counts (one row per partition)
reach the driver; offsets go back as a broadcast of that bounded table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import ensure_checkpoint_dir

RANGE_BYTES = 1 << 30   # of input for each range: what is sorted are a few of its columns, or counts of them
MOST_RANGES = 20_000
_POS_BITS = 33  # monotonically_increasing_id packs (partition << 33) | position


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables a frame reads, from the plan's leaves (no job); leaves
    of unknown size do not count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def _n_parts(df: DataFrame, n: int | None) -> int:
    """Ranges for a frame: the session's shuffle partitions, more for large inputs."""
    if n:
        return n
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return max(least, min(MOST_RANGES, _input_bytes(df) // RANGE_BYTES))


def range_sorted(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted within partitions, with ``_pid`` and
    ``_pos`` (position inside the partition); checkpointed so they hold still."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _n_parts(df, num_partitions)
    mid = F.monotonically_increasing_id()
    out = (df.repartitionByRange(n, *order_cols)
             .sortWithinPartitions(*order_cols)
             .withColumn("_mid", mid)
             .withColumn("_pid", F.shiftright(F.col("_mid"), _POS_BITS).cast("int"))
             .withColumn("_pos", F.col("_mid").bitwiseAND((1 << _POS_BITS) - 1))
             .drop("_mid"))
    return out.checkpoint(eager=True)


def with_row_index(df: DataFrame, order_cols: list[str], name: str = "row_idx",
                   num_partitions: int | None = None) -> DataFrame:
    """0-based global index by ``order_cols`` (which should be unique)."""
    rs = range_sorted(df, order_cols, num_partitions)
    counts = rs.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w_off = F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
    # one row per partition: a bounded, safe broadcast
    offsets = counts.select("_pid", F.coalesce(w_off, F.lit(0)).alias("_off"))
    return (rs.join(F.broadcast(offsets), "_pid")
              .withColumn(name, F.col("_off") + F.col("_pos"))
              .drop("_pid", "_pos", "_off"))


def prefix_sums(df: DataFrame, order_cols: list[str], value_cols: list[str],
                num_partitions: int | None = None, group_totals: str | None = None):
    """Running sums of ``value_cols`` in ``order_cols`` order over the whole
    table, as ``cum_<col>``: range partitions (checkpointed), per-partition
    totals (one row per partition to the driver, turned into offsets), and a
    running sum inside each range partition. The window's partition key is
    the range partition, so no task holds more than one range."""
    rs = range_sorted(df, order_cols, num_partitions)
    keys = ["_pid"] + ([group_totals] if group_totals else [])
    parts = rs.groupBy(*keys).agg(*[F.sum(c).cast("double").alias(c) for c in value_cols]).collect()
    per_pid: dict[int, list[float]] = {}
    per_group: dict = {}
    for r in parts:
        acc = per_pid.setdefault(int(r["_pid"]), [0.0] * len(value_cols))
        for i, c in enumerate(value_cols):
            acc[i] += r[c] or 0.0
        if group_totals:
            g = per_group.setdefault(r[group_totals], [0.0] * len(value_cols))
            for i, c in enumerate(value_cols):
                g[i] += r[c] or 0.0
    running = [0.0] * len(value_cols)
    rows = []
    for pid in sorted(per_pid):
        rows.append((pid, *running))
        running = [a + b for a, b in zip(running, per_pid[pid])]
    spark = df.sparkSession
    offs = spark.createDataFrame(rows, "_pid int, " + ", ".join(f"_o{i} double" for i in range(len(value_cols))))
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = rs.join(F.broadcast(offs), "_pid")  # one row per partition
    for i, c in enumerate(value_cols):
        out = out.withColumn(f"cum_{c}", F.sum(F.col(c).cast("double")).over(w) + F.col(f"_o{i}"))
    out = out.drop("_pid", "_pos", *[f"_o{i}" for i in range(len(value_cols))])
    return (out, per_group) if group_totals else out
