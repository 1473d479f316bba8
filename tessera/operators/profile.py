"""Profiling (PRF-1 .. PRF-9).

All per-column statistics of a kind come out of one aggregate. Value counts
(top-k, mode, distinct-with-null) go through a long (column, value) table:
``groupBy(column, value)`` combines map-side, so a value holding a third of
the rows costs one record per task, and rank filters become per-task group
limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import is_numeric, numeric_columns, q, text_columns
from tessera.functions.quantiles import exact_quantiles
from tessera.functions.util import with_row

SEVERITY_SCORE = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _pct_expr(c, ps, exact):
    arr = F.array(*[F.lit(p) for p in ps])
    if exact:
        return F.percentile(c, arr)
    return F.percentile_approx(c, arr, F.lit(10000))


# ------------------------------------------------------------------ PRF-1
def profile_numeric(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, median, sample std, min, max, q25, q75 (linear), population
    skewness and population excess kurtosis, per numeric column. Moments in
    one aggregate; quantiles from the distributed exact quantiles (or a
    bounded sketch with ``exact=False``)."""
    spark = df.sparkSession
    cols = cols if cols is not None else numeric_columns(df)
    exprs = []
    for i, c in enumerate(cols):
        x = q(c).cast("double")
        exprs.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.count(x).alias("count"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis")).alias(str(i)))
    wide = df.agg(*exprs)
    long = wide.select(F.explode(F.array(*[F.col(str(i)) for i in range(len(cols))])).alias("r")).select("r.*")
    if exact:
        qv = exact_quantiles(df, cols, [0.5, 0.25, 0.75])
    else:
        row = df.agg(*[_pct_expr(q(c).cast("double"), [0.5, 0.25, 0.75], False).alias(str(i))
                       for i, c in enumerate(cols)]).first()
        qv = {c: list(row[str(i)] or [None] * 3) for i, c in enumerate(cols)}
    qdf = spark.createDataFrame([(c, *[float(v) if v is not None else None for v in qv[c]]) for c in cols],
                                "column string, median double, q25 double, q75 double")
    return (long.filter(F.col("count") > 0).join(F.broadcast(qdf), "column")  # one row per column
                .select("position", "column", "count", "mean", "median", "std", "min", "max", "q25", "q75",
                        "skewness", "kurtosis"))


# -------------------------------------------------------------- value counts
def value_counts_long(df: DataFrame, cols: list[str], include_null: bool = True) -> DataFrame:
    """(column, value, count); values as text; null is a value when asked."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), q(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column", "kv.value")
    if not include_null:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def top_k_values(counts: DataFrame, k: int) -> DataFrame:
    """Rank values per column by count desc, value asc (null last)."""
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ------------------------------------------------------------------ PRF-2
def profile_categorical(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    """Per text column: distinct values (null counted as one), and the top
    ``k`` values with counts (null counts as a value). One row per (column, rank)."""
    cols = cols if cols is not None else text_columns(df)
    counts = value_counts_long(df, cols, include_null=True)
    uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return top_k_values(counts, k).join(uniq, "column").select(
        "column", "unique_count", "rank", "value", "count")


# ------------------------------------------------------------------ PRF-3
def profile_missing(df: DataFrame) -> DataFrame:
    """(column, count, percentage) for columns with at least one null."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(q(c).isNull()).alias(str(i)) for i, c in enumerate(cols)])
    long = agg.select("_n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(str(i)).alias("count"))
        for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    return long.filter(F.col("count") > 0).select(
        "position", "column", "count", (F.col("count") / F.col("_n")).alias("percentage"))


# ------------------------------------------------------------------ PRF-4
def pair_list(cols: list[str]) -> list[tuple[int, str, str]]:
    out = []
    k = 0
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            out.append((k, cols[i], cols[j]))
            k += 1
    return out


def correlation_pairs(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r for every pair, all in one aggregate."""
    cols = cols if cols is not None else numeric_columns(df)
    pairs = pair_list(cols)
    if not pairs:
        return df.sparkSession.createDataFrame([], "pair_idx int, col1 string, col2 string, correlation double, n long")
    exprs = []
    for k, a, b in pairs:
        xa, xb = q(a).cast("double"), q(b).cast("double")
        exprs.append(F.struct(F.lit(k).alias("pair_idx"), F.lit(a).alias("col1"), F.lit(b).alias("col2"),
                              F.corr(xa, xb).alias("correlation"),
                              F.count_if(xa.isNotNull() & xb.isNotNull()).alias("n")).alias(f"p{k}"))
    wide = df.agg(*exprs)
    return wide.select(F.explode(F.array(*[F.col(f"p{k}") for k, _, _ in pairs])).alias("r")).select("r.*")


def correlation_preview(df: DataFrame, cols: list[str] | None = None, k: int = 5) -> DataFrame:
    pairs = correlation_pairs(df, cols)
    return (pairs.filter(F.col("correlation").isNotNull())
                 .orderBy(F.desc(F.abs("correlation")), "pair_idx").limit(k)
                 .select("col1", "col2", "correlation"))


# ------------------------------------------------------------------ PRF-5
def identify_issues(df: DataFrame, exact: bool = True) -> DataFrame:
    """Issue rows: missing > 0.20 critical, > 0.10 high; text distinct (with
    null) > 1000 medium; values beyond Q1/Q3 -/+ 3 IQR in > 5 % of the
    non-null values (n >= 10) medium. Two passes: quartiles, then counts."""
    spark = df.sparkSession
    cols = df.columns
    nums = numeric_columns(df)
    texts = text_columns(df)
    exprs = [F.count(F.lit(1)).alias("_n")]
    exprs += [F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)]
    exprs += [F.count(q(c)).alias(f"n{i}") for i, c in enumerate(nums)]
    stats = df.agg(*exprs).first()  # one row, size bounded by the schema
    quart = exact_quantiles(df, nums, [0.25, 0.75]) if exact else {
        c: list(v or [None, None]) for c, v in zip(nums, df.agg(*[
            _pct_expr(q(c).cast("double"), [0.25, 0.75], False).alias(f"q{i}") for i, c in enumerate(nums)]).first())}
    n = stats["_n"]
    # distinct counts with null through the long value-count table
    uniq = {}
    if texts:
        for r in value_counts_long(df, texts).groupBy("column").agg(F.count(F.lit(1)).alias("u")).collect():
            uniq[r["column"]] = r["u"]
    bounds = {}
    for i, c in enumerate(nums):
        qs = quart.get(c)
        if stats[f"n{i}"] >= 10 and qs is not None and qs[0] is not None:
            iqr = qs[1] - qs[0]
            bounds[c] = (qs[0] - 3 * iqr, qs[1] + 3 * iqr, stats[f"n{i}"])
    out_counts = {}
    if bounds:
        row = df.agg(*[F.count_if((q(c).cast("double") < lo) | (q(c).cast("double") > hi)).alias(str(i))
                       for i, (c, (lo, hi, _)) in enumerate(bounds.items())]).first()
        out_counts = {c: row[str(i)] for i, c in enumerate(bounds)}
    rows = []
    for i, c in enumerate(cols):
        z = stats[f"z{i}"]
        pct = z / n if n else 0.0
        if pct > 0.20:
            rows.append((i, 0, "critical", c, "high_missing", int(z), float(pct)))
        elif pct > 0.10:
            rows.append((i, 0, "high", c, "moderate_missing", int(z), float(pct)))
    for c in texts:
        if uniq.get(c, 0) > 1000:
            rows.append((cols.index(c), 1, "medium", c, "high_cardinality", int(n), 1.0))
    for c, (lo, hi, nn) in bounds.items():
        o = out_counts[c]
        if o / nn > 0.05:
            rows.append((cols.index(c), 2, "medium", c, "outliers", int(o), float(o / nn)))
    return spark.createDataFrame(rows, "position int, check_order int, severity string, column string, "
                                       "issue_type string, affected_rows long, affected_pct double")


# ------------------------------------------------------------------ PRF-6
def top_issues(issues: DataFrame, k: int = 10) -> DataFrame:
    sev = F.create_map(*[x for kv in SEVERITY_SCORE.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return (issues.withColumn("severity_score", F.coalesce(sev[F.col("severity")], F.lit(0)))
                  .orderBy(F.desc("severity_score"), "check_order", "position").limit(k))


# ------------------------------------------------------------------ PRF-7
def short_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: dtype, count, null count, missing % (2 dp); numeric: mean,
    median, std, min, max (4 dp); text: distinct (no null), mode (smallest
    on tie) and its count."""
    cols = df.columns
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = text_columns(df)
    if exact:  # medians from the distributed exact quantiles, as literals
        med = {c: v[0] for c, v in exact_quantiles(df, nums, [0.5]).items()}
    exprs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = q(c)
        parts = [F.count(x).alias("count"), F.count_if(x.isNull()).alias("null_count")]
        if c in nums:
            xd = x.cast("double")
            parts += [F.avg(xd).alias("mean"),
                      (F.lit(med[c]).cast("double") if exact else
                       F.percentile_approx(xd, F.lit(0.5), F.lit(10000)).cast("double")).alias("median"),
                      F.stddev_samp(xd).alias("std"), F.min(xd).alias("min"), F.max(xd).alias("max")]
        else:
            parts += [F.lit(None).cast("double").alias(s) for s in ("mean", "median", "std", "min", "max")]
        exprs.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                              F.lit(df.schema[c].dataType.simpleString()).alias("dtype"), *parts).alias(str(i)))
    wide = df.agg(*exprs)
    base = wide.select("_n", F.explode(F.array(*[F.col(str(i)) for i in range(len(cols))])).alias("r")) \
               .select("_n", "r.*")
    base = base.select("position", "column", "dtype", "count", "null_count",
                       F.round(F.col("null_count") / F.col("_n") * 100, 2).alias("missing_pct"),
                       *[F.round(s, 4).alias(s) for s in ("mean", "median", "std", "min", "max")])
    if texts:
        counts = value_counts_long(df, texts, include_null=False)
        modes = top_k_values(counts, 1).select("column", F.col("value").alias("mode"),
                                               F.col("count").alias("mode_count"))
        uniq = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
        base = base.join(uniq, "column", "left").join(modes, "column", "left")
    else:
        base = (base.withColumn("unique_count", F.lit(None).cast("long"))
                    .withColumn("mode", F.lit(None).cast("string"))
                    .withColumn("mode_count", F.lit(None).cast("long")))
    return base


# -------------------------------------------------------------- PRF-8 / PRF-9
# Words in a name that rule a target out.
TARGET_BANNED = ["missing", "id", "phone", "address", "name", "ref"]

# Domain keywords that raise a binary column to a "high" target.
TARGET_KEYWORDS = {
    "logistics": ["status", "deliver", "delivered", "return", "rto", "on_time", "on hold", "origin",
                  "awb", "warehouse"],
    "e-commerce": ["purchase", "refund", "churn", "fraud", "cart", "order", "customer", "campaign"],
    "healthcare": ["readmission", "adverse", "no_show", "noshow", "showed", "show_up", "appointment",
                   "patient", "hipertension", "diabetes", "gender", "neighbourhood"],
    "retail": ["conversion", "coupon", "return", "upsell", "inventory", "store", "sku"],
    "finance": ["default", "fraud", "late_payment", "closure", "loan", "credit", "balance"],
}


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(position, column, dtype, nunique) with nulls excluded, in one aggregate."""
    cols = cols if cols is not None else df.columns
    wide = df.agg(*[F.count_distinct(q(c)).alias(str(i)) for i, c in enumerate(cols)],
                  *[F.max(q(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(cols)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(str(i)).alias("nunique"), F.col(f"z{i}").alias("has_null"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")


def target_candidates(df: DataFrame, domain: str = "logistics", k: int = 5) -> DataFrame:
    """Binary columns (2 distinct) whose name has no banned fragment; those
    with a domain keyword are 'high' and, if any, the only candidates."""
    kws = TARGET_KEYWORDS.get(domain, TARGET_KEYWORDS["logistics"])
    dc = distinct_counts(df).drop("has_null")
    low = F.lower(F.col("column"))
    banned = F.lit(False)
    for b in TARGET_BANNED:
        banned = banned | low.contains(b)
    kw = F.lit(False)
    for w in kws:
        kw = kw | low.contains(w)
    binary = dc.filter((F.col("nunique") == 2) & ~banned).withColumn("keyword", kw)
    has_kw = binary.agg(F.max(F.col("keyword").cast("int")).alias("_any"))
    return (with_row(binary, has_kw)
                  .filter(F.col("keyword") | (F.coalesce(F.col("_any"), F.lit(0)) == 0))
                  .orderBy("position").limit(k)
                  .select("position", F.col("column").alias("name"), "nunique",
                          F.when(F.col("keyword"), "binary outcome; matches domain keywords")
                           .otherwise("binary outcome").alias("reason"),
                          F.when(F.col("keyword"), "high").otherwise("medium").alias("confidence")))


def infer_target(df: DataFrame) -> DataFrame:
    """First binary column whose name has no identifier fragment, else the
    last column; rejected (null) when it is unique per row."""
    dc = distinct_counts(df)
    n = df.agg(F.count(F.lit(1)).alias("_rows"))
    low = F.lower(F.col("column"))
    ident = F.lit(False)
    for b in ("id", "uuid", "reference", "phone", "address", "name"):
        ident = ident | low.contains(b)
    last_pos = len(df.columns) - 1
    pick = (dc.withColumn("_binary", (F.col("nunique") == 2) & ~ident)
              .withColumn("_prio", F.when(F.col("_binary"), 0)
                          .when(F.col("position") == last_pos, 1).otherwise(None))
              .filter(F.col("_prio").isNotNull())
              .orderBy("_prio", "position").limit(1))
    return with_row(pick, n).select(
        F.col("column").alias("target"), "nunique",
        ((F.col("nunique") + F.col("has_null")) < F.col("_rows")).alias("accepted"))
