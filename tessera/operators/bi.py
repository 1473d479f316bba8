"""Structured BI queries: filters, aggregate, compare, trend, overview, group view
(BI-1 .. BI-9). A query is a plain dict spec (the parsed-question form); it
compiles to one DataFrame plan, so filters reach the Parquet scan and every
statistic of a query is computed in a single aggregate.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import (datetime_columns, is_numeric, numeric_columns, q,
                             resolve_column, text_columns)
from tessera.functions.quantiles import exact_quantiles, grouped_exact_quantiles

# Count on these metric names means "count distinct ids".
DISTINCT_COUNT_METRICS = ("patientid", "appointmentid", "patient_id", "appointment_id")

AGGS = ("mean", "median", "sum", "count", "min", "max", "std", "p90", "p95")

# pandas period alias -> Spark date_trunc unit
FREQ_UNITS = {"H": "hour", "h": "hour", "D": "day", "W": "week", "M": "month",
              "MS": "month", "Q": "quarter", "QS": "quarter", "Y": "year", "A": "year", "YS": "year"}


# ---------------------------------------------------------------- BI-1 filters
def filter_condition(df: DataFrame, filters: dict | None) -> Column | None:
    """AND of the filter spec; unknown columns are ignored."""
    if not filters:
        return None
    cond = None
    for k, v in filters.items():
        if k not in df.columns:
            continue
        c = q(k)
        parts = []
        if isinstance(v, dict):
            if "range" in v:
                lo, hi = v["range"]
                parts.append((c >= F.lit(lo)) & (c <= F.lit(hi)))
            if "in" in v:
                parts.append(c.isin(list(v["in"])))
            if "like" in v:
                parts.append(F.coalesce(c.cast("string").rlike(v["like"]), F.lit(False)))
        else:
            parts.append(c == F.lit(v))
        for p in parts:
            cond = p if cond is None else (cond & p)
    return cond


def apply_filters(df: DataFrame, filters: dict | None) -> DataFrame:
    cond = filter_condition(df, filters)
    return df if cond is None else df.filter(cond)


# ------------------------------------------------------------ aggregate exprs
def agg_expr(agg: str, c: Column, exact: bool = True) -> Column:
    pct = (lambda p: F.percentile(c, F.lit(p))) if exact else \
          (lambda p: F.percentile_approx(c, F.lit(p), F.lit(10000)).cast("double"))
    if agg == "mean":
        return F.avg(c)
    if agg == "median":
        return pct(0.5)
    if agg == "sum":
        return F.sum(c).cast("double")
    if agg == "count":
        return F.count(c)
    if agg == "min":
        return F.min(c).cast("double")
    if agg == "max":
        return F.max(c).cast("double")
    if agg == "std":
        return F.stddev_samp(c)
    if agg == "p90":
        return pct(0.9)
    if agg == "p95":
        return pct(0.95)
    raise ValueError(f"unknown aggregation {agg!r}; expected one of {AGGS}")


# --------------------------------------------------------------- BI-3 aggregate
def aggregate(df: DataFrame, metric: str, agg: str | list[str] = "mean",
              filters: dict | None = None, dimension: str | None = None,
              exact: bool = True) -> DataFrame:
    """One row per dimension value (or one row overall); one column per agg,
    named ``<agg>_<metric>``. Rows with a null metric or dimension are dropped."""
    aggs = [agg] if isinstance(agg, str) else list(agg)
    m = resolve_column(df.columns, metric)
    if m is None:
        raise ValueError(f"no column answers to the metric {metric!r}")
    d = resolve_column(df.columns, dimension) if dimension else None
    if dimension and d is None:
        raise ValueError(f"no column answers to the dimension {dimension!r}")
    out = apply_filters(df, filters)
    keys = [d] if d else []
    out = out.select(*[q(k) for k in keys], q(m).alias("_m"))

    if m.lower() in DISTINCT_COUNT_METRICS and aggs == ["count"]:
        out = out.dropna()
        return out.groupBy(*keys).agg(F.count_distinct("_m").alias(f"count_{m}"))

    if not is_numeric(df.schema[m].dataType):
        if aggs != ["count"]:
            raise ValueError(f"{metric!r} holds no numbers, so it can only be counted")
        return out.groupBy(*keys).agg(F.count("_m").alias(f"count_{m}"))

    out = out.dropna()  # null metric and null dimension rows are dropped
    return _grouped_stats(out, keys, "_m", aggs, m, exact)


QUANTILE_AGGS = {"median": 0.5, "p90": 0.9, "p95": 0.95}


def _grouped_stats(df: DataFrame, keys: list[str], col: str, aggs: list[str], label: str | None,
                   exact: bool) -> DataFrame:
    """Moments by a groupBy; exact quantiles by the distributed grouped
    quantiles (no group's values gathered in one task), joined on the keys."""
    name = (lambda a: f"{a}_{label}") if label else (lambda a: a)
    x = F.col(col).cast("double")
    quant = [a for a in aggs if a in QUANTILE_AGGS] if exact else []
    plain = [a for a in aggs if a not in quant]
    base = (df.groupBy(*keys).agg(*[agg_expr(a, x, exact).alias(name(a)) for a in plain]) if plain
            else df.select(*keys).distinct() if keys else None)
    if not quant:
        return base
    probs = [QUANTILE_AGGS[a] for a in quant]
    if keys:
        qdf = grouped_exact_quantiles(df, keys, col, probs, [name(a) for a in quant])
        res = qdf if base is None else base.join(qdf, keys)
    else:
        vals = exact_quantiles(df, [col], probs)[col]
        lits = [F.lit(v).cast("double").alias(name(a)) for a, v in zip(quant, vals)]
        res = (df.sparkSession.range(1).select(*lits) if base is None else base.select("*", *lits))
    return res.select(*keys, *[name(a) for a in aggs])


# ---------------------------------------------------------------- BI-4 compare
def compare(df: DataFrame, metric: str, dimension: str, filters: dict | None = None,
            exact: bool = True) -> DataFrame:
    m = resolve_column(df.columns, metric)
    d = resolve_column(df.columns, dimension)
    if m is None or d is None:
        raise ValueError(f"no columns answer to {metric!r} by {dimension!r}")
    data = apply_filters(df, filters).select(q(d), q(m).alias("_m")).dropna()
    return _grouped_stats(data, [d], "_m", ["mean", "median", "count", "std"], None, exact)


# -------------------------------------------------------- BI-5 compare dummies
def compare_dummies(df: DataFrame, prefix: str, filters: dict | None = None) -> DataFrame:
    """Count of true per dummy column ``<prefix>_*`` (one row per level)."""
    cols = [c for c in df.columns if c.startswith(prefix + "_")]
    if not cols:
        raise ValueError(f"no columns start with {prefix}_")
    sums = apply_filters(df, filters).agg(
        *[F.sum(q(c).cast("int")).cast("long").alias(c) for c in cols])
    stack = ", ".join(f"'{c[len(prefix) + 1:]}', `{c}`" for c in cols)
    return sums.selectExpr(f"stack({len(cols)}, {stack}) as (level, n_true)")


# ------------------------------------------------------------------ BI-6 trend
def trend(df: DataFrame, metric: str, freq: str = "D", filters: dict | None = None,
          time_col: str | None = None) -> DataFrame:
    """Mean of the metric per period of the first datetime column."""
    m = resolve_column(df.columns, metric)
    if m is None:
        raise ValueError(f"no column answers to the metric {metric!r}")
    dts = datetime_columns(df)
    t = time_col or (dts[0] if dts else None)
    if t is None:
        raise ValueError("no datetime column")
    unit = FREQ_UNITS.get(freq, freq)
    return (apply_filters(df, filters)
            .select(q(t).alias("_t"), q(m).cast("double").alias("_m")).dropna()
            .groupBy(F.date_trunc(unit, F.col("_t")).cast("timestamp_ntz").alias("period"))
            .agg(F.avg("_m").alias(f"mean_{m}")))


# --------------------------------------------------------------- BI-7 overview
def overview(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column: dtype, nulls, and for numeric columns mean, median,
    std, min, max, distinct. Moments and null counts in one aggregate,
    distinct counts in one more, medians from the distributed exact
    quantiles (or a bounded sketch with ``exact=False``)."""
    nums = numeric_columns(df)
    exprs = [F.count(F.lit(1)).alias("__rows")]
    for c in df.columns:
        exprs.append(F.count_if(q(c).isNull()).alias(f"{c}__nulls"))
    for c in nums:
        x = q(c).cast("double")
        exprs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                  F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
    wide = df.agg(*exprs)
    uniq = df.agg(*[F.count_distinct(q(c)).alias(f"{c}__unique") for c in nums]).first() if nums else {}
    if exact:
        med = {c: v[0] for c, v in exact_quantiles(df, nums, [0.5]).items()}
    else:
        r = df.agg(*[agg_expr("median", q(c).cast("double"), False).alias(c) for c in nums]).first() if nums else {}
        med = {c: r[c] for c in nums}
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = f.name
        num = c in nums
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"`{c}__nulls`").cast("long").alias("missing"),
            (F.col(f"`{c}__mean`") if num else F.lit(None).cast("double")).alias("mean"),
            F.lit(med.get(c)).cast("double").alias("median"),
            *[(F.col(f"`{c}__{s_}`") if num else F.lit(None).cast("double")).alias(s_) for s_ in ("std", "min", "max")],
            F.lit(uniq[f"{c}__unique"] if num else None).cast("long").alias("unique_count")))
    out = (wide.select(F.col("__rows").alias("total_records"), F.explode(F.array(*rows)).alias("r"))
               .select("total_records", "r.*"))
    return out


def top_values(df: DataFrame, cols: list[str] | None = None, k: int = 10) -> DataFrame:
    """Top-k values per text column by count (tie: value ascending), nulls
    excluded, plus each column's distinct count. Rank filter <= k is planned as
    a map-side group limit, so only k rows per column per task are shuffled."""
    cols = cols if cols is not None else text_columns(df)
    if not cols:
        raise ValueError("no categorical columns")
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value").filter(F.col("value").isNotNull())
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w))
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return ranked.filter(F.col("rank") <= k).join(uniq, "column")


# ------------------------------------------------------------ BI-8 dispatch
def run_query(df: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """Dispatch a parsed question (intent, metric, aggregation, dimension,
    filters, freq) to one plan."""
    intent = spec.get("intent")
    filters = spec.get("filters")
    exact = spec.get("exact", True)
    if intent == "aggregate":
        return aggregate(df, spec["metric"], spec.get("aggregation", "mean"), filters,
                         spec.get("dimension"), exact)
    if intent == "compare":
        return compare(df, spec["metric"], spec["dimension"], filters, exact)
    if intent == "trend":
        return trend(df, spec["metric"], spec.get("freq", "D"), filters, spec.get("time_col"))
    if intent == "overview":
        return overview(apply_filters(df, filters), exact)
    raise ValueError(f"unknown intent {intent!r}")


# -------------------------------------------------------------- BI-9 group view
def group_view(grouped: DataFrame, key: str, value: str, top: int = 10,
               high: float = 50, low: float = 5, per_band: int = 3) -> DataFrame:
    """Dashboard view of a per-group value: the top groups, and the largest
    groups at/above ``high`` and at/below ``low`` (ties: key ascending)."""
    v = F.col(value)
    order = [v.desc(), F.col(key).asc()]
    # orderBy + limit plans as a per-task top-k (TakeOrderedAndProject), not
    # a full sort of the groups.
    top_df = grouped.orderBy(*order).limit(top).withColumn("section", F.lit("top"))
    hi_df = grouped.filter(v >= high).orderBy(*order).limit(per_band).withColumn("section", F.lit("high"))
    lo_df = grouped.filter(v <= low).orderBy(*order).limit(per_band).withColumn("section", F.lit("low"))
    out = top_df.unionByName(hi_df).unionByName(lo_df)
    return (out.withColumn("rank", F.row_number().over(Window.partitionBy("section").orderBy(*order)))
               .select("section", "rank", F.col(key).cast("string").alias("group"), v.alias("value")))


def group_summary(grouped: DataFrame, value: str) -> DataFrame:
    """Total, number of groups, max and rounded mean per group."""
    v = F.col(value)
    return grouped.agg(F.sum(v).cast("double").alias("total"),
                       F.count(F.lit(1)).alias("n_groups"),
                       F.max(v).cast("double").alias("max_value"),
                       F.round(F.sum(v) / F.count(F.lit(1)), 0).alias("mean_per_group"))
