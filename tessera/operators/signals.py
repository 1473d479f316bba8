"""Statistical signals, rule recommendations, quality score, drift baseline
(SIG-1 .. SIG-7, REC-1, REC-2, MON-1).

Signals form one long table ``(section, column, metric, value)``; each
section is one aggregate over all numeric columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import datetime_columns, numeric_columns, q
from tessera.functions.quantiles import exact_quantiles
from tessera.functions.util import with_row
from tessera.operators.bi import FREQ_UNITS
from tessera.operators.kpi import compute_kpis

LONG_SCHEMA = "section string, column string, metric string, value double"

# Primary metric per domain, used for the trend signal.
PRIMARY_METRIC = {"logistics": "transit_time", "healthcare": "los_days", "emarketing": "ctr",
                  "retail": "order_value", "finance": "balance"}


def _long(wide: DataFrame, items: list[tuple[str, str, str, str]]) -> DataFrame:
    """wide one-row frame + (section, column, metric, field) -> long rows."""
    if not items:
        return wide.sparkSession.createDataFrame([], LONG_SCHEMA)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.lit(c).alias("column"), F.lit(m).alias("metric"),
                 F.col(f).cast("double").alias("value")) for s, c, m, f in items])).alias("r")).select("r.*")


# ------------------------------------------------------------------ SIG-1
def missing_pct(df: DataFrame) -> DataFrame:
    wide = df.agg(*[(F.avg(q(c).isNull().cast("double")) * 100).alias(f"m{i}") for i, c in enumerate(df.columns)])
    return _long(wide, [("quality", c, "missing_pct", f"m{i}") for i, c in enumerate(df.columns)])


# ------------------------------------------------------------------ SIG-2
def duplicate_pct(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each key combination (nulls equal) x 100."""
    groups = df.groupBy(*[q(k) for k in keys]).agg(F.count(F.lit(1)).alias("_c"))
    wide = groups.agg(((F.sum("_c") - F.count(F.lit(1))) / F.sum("_c") * 100).alias("d"))
    return _long(wide, [("quality", ",".join(keys), "duplicates_pct", "d")])


# ------------------------------------------------------------------ SIG-3
def shape(df: DataFrame, cols: list[str] | None = None, min_n: int = 10) -> DataFrame:
    """Bias-corrected skewness G1 and excess kurtosis G2 from Spark's
    population moments g1, g2 (n >= 10)."""
    cols = cols if cols is not None else numeric_columns(df)
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        exprs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"s{i}"), F.kurtosis(x).alias(f"k{i}")]
    wide = df.agg(*exprs)
    sel = []
    for i in range(len(cols)):
        n = F.col(f"n{i}").cast("double")
        ok = n >= min_n
        g1 = F.when(ok, F.col(f"s{i}") * F.sqrt(n * (n - 1)) / (n - 2))
        g2 = F.when(ok, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col(f"k{i}") + 6))
        sel += [g1.alias(f"g1_{i}"), g2.alias(f"g2_{i}")]
    items = []
    for i, c in enumerate(cols):
        items += [("shape", c, "skew", f"g1_{i}"), ("shape", c, "kurtosis", f"g2_{i}")]
    return _long(wide.select(*sel), items).filter(F.col("value").isNotNull())


def _held(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as doubles, kept for the passes of the exact quantiles, so that
    what makes the table (its joins) runs once."""
    return df.select(*[q(c).cast("double").alias(c) for c in cols]).persist()


# ------------------------------------------------------------------ SIG-4
def outlier_pct_iqr(df: DataFrame, cols: list[str] | None = None, k: float = 1.5, min_n: int = 10) -> DataFrame:
    """Share (x 100) of non-null values beyond Q1 - k IQR / Q3 + k IQR.
    Quartiles come from the distributed exact quantiles; the bounds are
    then literals of a single counting aggregate."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    held = _held(df, cols)
    try:
        return _outlier_pct(held, cols, k, min_n)
    finally:
        held.unpersist()


def _outlier_pct(df: DataFrame, cols: list[str], k: float, min_n: int) -> DataFrame:
    qs = exact_quantiles(df, cols, [0.25, 0.75])
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        q1, q3 = qs[c]
        n = F.count(x)
        if q1 is None:
            exprs.append(F.lit(None).cast("double").alias(f"o{i}"))
            continue
        lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        exprs.append(F.when(n >= min_n, F.count_if((x < lo) | (x > hi)) / n * 100).alias(f"o{i}"))
    row = df.agg(*exprs).first()
    rows = [("outliers", c, "outliers_pct_iqr", row[f"o{i}"]) for i, c in enumerate(cols) if row[f"o{i}"] is not None]
    return df.sparkSession.createDataFrame(rows, LONG_SCHEMA)


# ------------------------------------------------------------------ SIG-5
def tail_quantiles(df: DataFrame, cols: list[str] | None = None, probs=(0.9, 0.95), min_n: int = 10) -> DataFrame:
    """p90 / p95 of columns with at least 10 values (distributed exact)."""
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    held = _held(df, cols)
    try:
        counts = held.agg(*[F.count(q(c)).alias(c) for c in cols]).first()
        ok = [c for c in cols if counts[c] >= min_n]
        qs = exact_quantiles(held, ok, list(probs))
    finally:
        held.unpersist()
    rows = [("quantiles", c, f"p{int(round(p * 100))}", float(qs[c][j]))
            for c in ok for j, p in enumerate(probs) if qs[c][j] is not None]
    return df.sparkSession.createDataFrame(rows, LONG_SCHEMA)


# ------------------------------------------------------------------ SIG-6
def trend_slope(df: DataFrame, metric: str, freq: str = "D", time_col: str | None = None,
                min_points: int = 5) -> DataFrame:
    """Least-squares slope of the per-period means against their index
    0..m-1 (periods present only), divided by the mean of the means (1 if
    that is 0), x 100. The per-period table has one row per period, so the
    index window runs over a table bounded by the time span, not the data."""
    dts = datetime_columns(df)
    t = time_col or (dts[0] if dts else None)
    if t is None or metric not in df.columns:
        return df.sparkSession.createDataFrame([], LONG_SCHEMA)
    unit = FREQ_UNITS.get(freq, freq)
    per = (df.select(q(t).alias("_t"), q(metric).cast("double").alias("_m")).dropna()
             .groupBy(F.date_trunc(unit, "_t").alias("period")).agg(F.avg("_m").alias("y")))
    idx = per.withColumn("t", (F.row_number().over(Window.orderBy("period")) - 1).cast("double"))
    wide = idx.agg(F.regr_slope("y", "t").alias("slope"), F.avg("y").alias("ybar"),
                   F.count(F.lit(1)).alias("m"))
    res = wide.select(
        F.when(F.col("m") >= min_points,
               F.col("slope") / F.when(F.col("ybar") == 0, F.lit(1.0)).otherwise(F.col("ybar")) * 100)
        .alias("slope_norm_pct"),
        F.when(F.col("m") >= min_points, F.col("m")).alias("n_points"))
    return _long(res, [("trends", metric, "slope_norm_pct", "slope_norm_pct"),
                       ("trends", metric, "n_points", "n_points")]).filter(F.col("value").isNotNull())


# ------------------------------------------------------------------ SIG-7
def build_signals(df: DataFrame, domain: str, key_cols: list[str] | None = None) -> DataFrame:
    """All signals in one long table: meta, kpis, quality, distributions,
    trends. The sections read the same input several times, so it is
    persisted for the duration; every section is a small table (columns x
    metrics), so the result is assembled from the collected sections."""
    spark = df.sparkSession
    src = df.persist()
    try:
        kp = compute_kpis(src, domain)
        parts = [_long(src.agg(F.count(F.lit(1)).alias("n")), [("meta", "", "n", "n")]),
                 _long(kp, [("kpis", "", c, c) for c in kp.columns]), missing_pct(src)]
        if key_cols:
            parts.append(duplicate_pct(src, key_cols))
        parts += [shape(src), outlier_pct_iqr(src), tail_quantiles(src)]
        metric = PRIMARY_METRIC.get(domain)
        if metric and metric in src.columns:
            parts.append(trend_slope(src, metric))
        rows = [tuple(r) for p in parts for r in p.collect()]
    finally:
        src.unpersist()
    return spark.createDataFrame(rows, LONG_SCHEMA)


# ------------------------------------------------------------------ REC-1
# Recommendation rules (domain, title, severity, predicate over
# the one-row KPI table plus ``transit_slope``), in the reference's order.
RULES = [
    ("logistics", "Carrier/HUB performance audit", "high",
     "coalesce(sla_pct, 100) < 90 AND coalesce(transit_slope, 0) > 0"),
    ("logistics", "Reduce RTO", "medium", "coalesce(rto_pct, 0) > 5"),
    ("logistics", "First Attempt Success improvement", "medium", "coalesce(fas_pct, 100) < 85"),
    ("emarketing", "Reallocate spend", "high", "coalesce(roas, 1) < 1 AND has_ctr"),
    ("emarketing", "Creative refresh needed", "medium", "coalesce(ctr_pct, 0) < 1"),
    ("retail", "Quality/size review", "medium", "coalesce(return_pct, 0) > 8"),
    ("retail", "Basket size optimization", "low",
     "coalesce(aov, 0) < coalesce(gmv, 0) / coalesce(total_orders, 1) * 0.8"),
    ("healthcare", "Discharge protocol review", "high", "coalesce(readmission_30d_pct, 0) > 15"),
    ("healthcare", "Length of stay optimization", "medium", "coalesce(avg_los_days, 0) > 7"),
    ("finance", "Tighten underwriting", "high", "coalesce(npl_pct, 0) > 6"),
    ("finance", "Liquidity monitoring", "high", "coalesce(liquidity_ratio, 1) < 1.2"),
]


def recommend(df: DataFrame, domain: str, limit: int = 3) -> DataFrame:
    """Rule-based recommendations: predicates over the KPI row (one scan of
    the data for the KPIs, one for the trend), first ``limit`` that fire.
    A KPI that is null counts as absent, as a missing key does."""
    kp = compute_kpis(df, domain)
    metric = PRIMARY_METRIC.get(domain)
    if domain == "logistics" and metric in df.columns:
        sl = trend_slope(df, metric).filter(F.col("metric") == "slope_norm_pct") \
            .agg(F.first("value").alias("transit_slope"))
    else:
        sl = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("transit_slope"))
    row = with_row(kp, sl).withColumn("has_ctr", F.lit("ctr_pct" in kp.columns))
    fired = []
    for i, (dom, title, sev, pred) in enumerate(RULES):
        if dom != domain:
            continue
        needed = [c for c in ("sla_pct", "rto_pct", "fas_pct", "roas", "ctr_pct", "return_pct", "aov", "gmv",
                              "total_orders", "readmission_30d_pct", "avg_los_days", "npl_pct",
                              "liquidity_ratio") if c in pred]
        r = row
        for c in needed:
            if c not in r.columns:
                r = r.withColumn(c, F.lit(None).cast("double"))
        fired.append(r.filter(F.expr(pred)).select(F.lit(i).alias("rule"), F.lit(title).alias("title"),
                                                   F.lit(sev).alias("severity")))
    if not fired:
        return df.sparkSession.createDataFrame([], "rule int, title string, severity string")
    out = fired[0]
    for f in fired[1:]:
        out = out.unionByName(f)
    return out.orderBy("rule").limit(limit)


# ------------------------------------------------------------------ REC-2
def quality_score(df: DataFrame) -> DataFrame:
    """100 - 0.5 x duplicate-row % - 0.3 x missing-cell %, held in 0..100."""
    cols = df.columns
    n = F.count(F.lit(1))
    miss = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0)) / (n * len(cols)) * 100
    base = df.agg(n.alias("n"), miss.alias("missing_rate"))
    j = with_row(base, df.dropDuplicates().agg(F.count(F.lit(1)).alias("n_distinct")))
    dup = (F.col("n") - F.col("n_distinct")) / F.col("n") * 100
    return j.select(dup.alias("duplicate_rate"), F.col("missing_rate"),
                    F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - 0.5 * dup - 0.3 * F.col("missing_rate")))
                    .alias("quality_score"))


# ------------------------------------------------------------------ MON-1
# Thresholds of the drift status.
PSI_WARN, PSI_ACT, KS_WARN, KS_ACT = 0.10, 0.25, 0.10, 0.20


def drift_baseline(df: DataFrame, cols: list[str] | None = None, min_n: int = 10) -> DataFrame:
    """Mean and sample std per numeric column with >= 10 values, with the
    drift thresholds the monitors use."""
    cols = cols if cols is not None else numeric_columns(df)
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        exprs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.count(x).alias("n"),
                              F.avg(x).alias("baseline_mean"), F.stddev_samp(x).alias("baseline_std")).alias(f"s{i}"))
    wide = df.agg(*exprs)
    return (wide.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("r")).select("r.*")
                .filter(F.col("n") >= min_n)
                .select("position", "feature", "n", "baseline_mean", "baseline_std",
                        F.lit(PSI_WARN).alias("psi_warn_threshold"), F.lit(PSI_ACT).alias("psi_action_threshold"),
                        F.lit(KS_WARN).alias("ks_warn_threshold"), F.lit(KS_ACT).alias("ks_action_threshold")))
