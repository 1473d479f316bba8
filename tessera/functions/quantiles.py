"""Exact quantiles (linear interpolation, as numpy / pandas) without sorting or
shuffling a column.

Ranks are found by refining a histogram. A pass counts each column's values in
``BUCKETS`` parts of an interval (map-side combined, so at most columns x buckets
records a task) with the least and greatest value of each part; the next pass looks
only at the parts that hold wanted ranks, cut anew between their least and greatest
value. When these hold few rows, their values are fetched and the ranks read off;
should they still hold many after ``PASSES`` (values that lie ever closer), only
their rows are sorted, by ranges. All columns and ranks of a request share the passes.
Nothing but histograms of fixed size reaches the driver.

Grouped quantiles count per (group, value) and take running counts over range
partitions (``plans.order.prefix_sums``), so no task holds a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.columns import q
from tessera.plans.order import prefix_sums

BUCKETS = 4096
FETCH = 200_000     # rows whose values are fetched to read off ranks
PASSES = 5


def _between(v: Column, lo, hi) -> Column:
    return (v >= F.lit(lo)) & (v <= F.lit(hi))


def _part(v: Column, lo, hi, kind: str) -> Column:
    """Part of [lo, hi] that holds v; never falls as v rises."""
    if kind == "long":
        return F.floor((v - F.lit(lo)) / F.lit((hi - lo) // BUCKETS + 1)) if hi - lo < 1 << 52 else F.shiftright(v, 52)
    if hi == lo:
        return F.lit(0).cast("long")
    at = F.floor((v * 0.5 - F.lit(lo * 0.5)) / F.lit(hi * 0.5 - lo * 0.5) * BUCKETS)
    return F.when(v < lo, -1).when(v > hi, BUCKETS).otherwise(F.least(at, F.lit(BUCKETS - 1))).cast("long")


def select_ranks(df: DataFrame, values: list[Column], ranks: Callable[[int, int], list[int]], kind: str = "double") -> tuple[dict, list[int]]:
    """({(i, rank): (value, rows below it, rows equal to it)}, rows by column) for the
    0-based ranks ``ranks(i, n)`` among the n non-null values of ``values[i]``, which
    are doubles or longs."""
    clean = [v.cast(kind) for v in values]
    if kind == "double":
        clean = [F.nanvl(v, F.lit(None)) for v in clean]
        inf = float("inf")
        finite = [F.when((v < inf) & (v > -inf), v) for v in clean]
        row = df.agg(*[F.min(v).alias(f"l{i}") for i, v in enumerate(finite)], *[F.max(v).alias(f"h{i}") for i, v in enumerate(finite)]).first()
        # [column, least, greatest, rows, rows before] of every open interval
        open_ = [[i, row[f"l{i}"] if row[f"l{i}"] is not None else 0.0, row[f"h{i}"] if row[f"h{i}"] is not None else 0.0, None, 0] for i in range(len(clean))]
    else:
        open_ = [[i, -(1 << 63), (1 << 63) - 1, None, 0] for i in range(len(clean))]
    found: dict = {}
    rows_of, wanted = [0] * len(clean), None
    for turn in range(PASSES):
        fetch = turn > 0 and sum(o[3] for o in open_) <= FETCH
        cells = []
        for i, v in enumerate(clean):
            mine = [(k, o) for k, o in enumerate(open_) if o[0] == i]
            at = F.lit(None).cast("struct<k:int,b:long>")
            for k, (_, lo, hi, *_rest) in reversed(mine):
                cell = F.struct(F.lit(k).alias("k"), (F.lit(0).cast("long") if fetch else _part(v, lo, hi, kind)).alias("b"))
                at = F.when(_between(v, lo, hi), cell).otherwise(at) if turn else F.when(v.isNotNull(), cell)
            cells.append(F.when(at.isNotNull(), F.struct(at["k"].alias("k"), at["b"].alias("b"), v.alias("v"))))
        long = df.select(F.explode(F.array(*cells)).alias("s")).filter("s is not null").select("s.k", "s.b", "s.v")
        if fetch:
            t = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).toArrow()
            low = high = t["v"].to_numpy()
        else:
            t = long.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).toArrow()
            low, high = t["lo"].to_numpy(), t["hi"].to_numpy()
        key, count = t["k"].to_numpy(), t["n"].to_numpy()
        if turn == 0:
            rows_of = [int(count[key == k].sum()) for k in range(len(open_))]
            wanted = [sorted({r for r in ranks(i, n) if 0 <= r < n}) for i, n in enumerate(rows_of)]
        nxt: dict = {}
        for k, (i, _, _, _, before) in enumerate(open_):
            at = np.flatnonzero(key == k)
            at = at[np.argsort(low[at], kind="stable")]
            upto = before + np.cumsum(count[at])
            for r in wanted[i]:
                p = int(np.searchsorted(upto, r, "right"))
                if (i, r) in found or r < before or p >= len(at):
                    continue
                lo, hi, n = low[at[p]].item(), high[at[p]].item(), int(count[at[p]])
                if lo == hi:
                    found[i, r] = (lo, int(upto[p]) - n, n)
                else:
                    nxt[i, lo] = [i, lo, hi, n, int(upto[p]) - n]
        open_ = list(nxt.values())
        if not open_:
            return found, rows_of
    for i, lo, hi, _, before in open_:  # only the rows between two neighbouring values of the histogram
        part = df.select(clean[i].alias("v")).filter(_between(F.col("v"), lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        cum = prefix_sums(part, ["v"], ["n"])
        for r in wanted[i]:
            if (i, r) not in found and before <= r:
                hit = cum.filter((F.col("cum_n") > r - before) & (F.col("cum_n") - F.col("n") <= r - before)).first()
                if hit:
                    found[i, r] = (hit["v"], before + int(hit["cum_n"]) - hit["n"], hit["n"])
    return found, rows_of


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """{column: [quantile for each prob]} over the non-null values; a column
    without values gives None."""
    if not cols:
        return {}
    around = [lambda n, p=p: (math.floor(p * (n - 1)), math.ceil(p * (n - 1))) for p in probs]
    found, rows = select_ranks(df, [q(c) for c in cols], lambda i, n: [r for f in around for r in f(n)])
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    for i, c in enumerate(cols):
        for j, p in enumerate(probs if rows[i] else ()):
            lo, hi = around[j](rows[i])
            a, b, pos = found[i, lo][0], found[i, hi][0], p * (rows[i] - 1)
            out[c][j] = a if a == b else a + (b - a) * (pos - lo)
    return out


def grouped_exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
                            names: list[str] | None = None, num_partitions: int | None = None) -> DataFrame:
    """Exact per-group quantiles (linear), fully distributed: one row per
    group with one column per probability. A group holding a third of all
    rows is still spread over many range partitions; per-group starts and
    sizes are joined back (AQE splits a skewed group's side)."""
    names = names or [f"q{j}" for j in range(len(probs))]
    g = [q(c).alias(f"_g{i}") for i, c in enumerate(group_cols)]
    gk = [f"_g{i}" for i in range(len(group_cols))]
    x = q(value_col).cast("double")
    counts = (df.select(*g, x.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
                .groupBy(*gk, "v").agg(F.count(F.lit(1)).alias("n")))
    cum = prefix_sums(counts, [*gk, "v"], ["n"], num_partitions)
    per_group = cum.groupBy(*gk).agg(F.min(F.col("cum_n") - F.col("n")).alias("_start"),
                                     F.sum("n").alias("_size"))
    rel = cum.join(per_group, gk)  # one row per group on the right
    lo_rank = F.col("cum_n") - F.col("n") - F.col("_start")   # rank of this value's first copy in the group
    hi_rank = F.col("cum_n") - F.col("_start")                 # one past its last copy
    picks = []
    for j, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_size") - 1)
        for side, r in ((0, F.floor(pos)), (1, F.ceil(pos))):
            picks.append(F.when((lo_rank <= r) & (r < hi_rank),
                                F.struct(F.lit(j).alias("j"), F.lit(side).alias("side"), F.col("v").alias("v"),
                                         (pos - F.floor(pos)).alias("frac"))))
    hits = (rel.select(*gk, F.explode(F.filter(F.array(*picks), lambda s: s.isNotNull())).alias("h"))
               .select(*gk, "h.*"))
    agg = []
    for j, nm in enumerate(names):
        lo = F.max(F.when((F.col("j") == j) & (F.col("side") == 0), F.col("v")))
        hi = F.max(F.when((F.col("j") == j) & (F.col("side") == 1), F.col("v")))
        fr = F.max(F.when(F.col("j") == j, F.col("frac")))
        agg.append((lo + (hi - lo) * fr).alias(nm))
    out = hits.groupBy(*gk).agg(*agg)
    return out.select(*[F.col(k).alias(c) for k, c in zip(gk, group_cols)], *names)
