"""Two-sample statistics (PSI over decile bins, Kolmogorov-Smirnov) of many columns.

Both tables are read once: counts per (column, value) with one count for each side,
and running counts of both over range partitions (``plans.order.prefix_sums``). The
first side's deciles, the bins' shares of both sides and the largest distance of the
two distribution functions are all read off this one sorted table. The work after the
scans grows with the distinct values; no task holds a column."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.columns import q
from tessera.plans.order import prefix_sums

EMPTY_SHARE = 0.0001    # fixed value: stands for an empty bin


@dataclass
class TwoSample:
    """Of one column: rows of both sides, the first side's distinct decile edges, both statistics."""
    n_a: int
    n_b: int
    edges: list[float]
    psi: float
    ks: float | None


def _sides(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    def long(df: DataFrame, one: int, two: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("c"), F.nanvl(q(c).cast("double"), F.lit(None)).alias("v")) for i, c in enumerate(cols)])
        return df.select(F.explode(cells).alias("s")).select("s.c", "s.v").filter("v is not null").select("c", "v", F.lit(one).alias("a"), F.lit(two).alias("b"))

    return long(a, 1, 0).unionByName(long(b, 0, 1)).groupBy("c", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def two_sample(a: DataFrame, b: DataFrame, cols: list[str], bins: int = 10) -> dict[str, TwoSample]:
    """{column: TwoSample}; KS is None where a side has no value."""
    from tessera.operators.impute import bin_index
    if not cols:
        return {}
    cum, per_col = prefix_sums(_sides(a, b, cols), ["c", "v"], ["a", "b"], group_totals="c")
    size = {i: tuple(int(x) for x in per_col.get(i, (0, 0))) for i in range(len(cols))}
    start, run = {}, (0, 0)  # running sums go on from column to column
    for i in range(len(cols)):
        start[i], run = run, (run[0] + size[i][0], run[1] + size[i][1])
    targets = [(i, j, side, start[i][0] + r) for i in range(len(cols)) if size[i][0] for j in range(bins + 1)
               for side, r in enumerate((math.floor(j / bins * (size[i][0] - 1)), math.ceil(j / bins * (size[i][0] - 1))))]
    edges: dict[int, list[float]] = {i: [] for i in range(len(cols))}
    if targets:
        wanted = cum.sparkSession.createDataFrame(targets, "tc int, tj int, side int, rank long")  # columns x 2 (bins + 1) rows
        hits = {(r["tc"], r["tj"], r["side"]): r["v"] for r in cum.join(
            F.broadcast(wanted), (F.col("c") == F.col("tc")) & (F.col("cum_a") - F.col("a") <= F.col("rank")) & (F.col("rank") < F.col("cum_a")))
            .select("tc", "tj", "side", "v").collect()}
        for i in range(len(cols)):
            n, at = size[i][0], []
            for j in range(bins + 1 if n else 0):
                pos = j / bins * (n - 1)
                lo, hi = hits[i, j, 0], hits[i, j, 1]
                at.append(lo if lo == hi else lo + (hi - lo) * (pos - math.floor(pos)))
            edges[i] = sorted(set(at))
    bin_, gap = F.lit(None).cast("int"), F.lit(None).cast("double")
    for i in range(len(cols)):
        here = F.col("c") == i
        if len(edges[i]) >= 2:
            bin_ = F.when(here, bin_index(F.col("v"), edges[i])).otherwise(bin_)
        if all(size[i]):
            gap = F.when(here, F.abs((F.col("cum_a") - start[i][0]) / size[i][0] - (F.col("cum_b") - start[i][1]) / size[i][1])).otherwise(gap)
    counts: dict = {}
    far: dict[int, float] = {}
    for r in cum.groupBy("c", bin_.alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max(gap).alias("ks")).collect():
        counts[r["c"], r["bin"]] = (r["a"], r["b"])
        if r["ks"] is not None:
            far[r["c"]] = max(far.get(r["c"], 0.0), r["ks"])
    out = {}
    for i, c in enumerate(cols):
        psi = 0.0
        for j in range(len(edges[i]) - 1):
            x, y = ((n / total if total else 0.0) or EMPTY_SHARE for n, total in zip(counts.get((i, j), (0, 0)), size[i]))
            psi += (y - x) * math.log(y / x)
        out[c] = TwoSample(*size[i], edges[i], psi, far.get(i))
    return out
