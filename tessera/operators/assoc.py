"""Associations, tests and business-rule checks (COR-1 .. COR-7, BIZ-1 .. BIZ-3).

* Pearson: every pair's r and complete-case n in ONE aggregate.
* Contingency tables for all categorical pairs in ONE pass: rows are
  exploded to (pair, a, b) and counted with a map-side-combined groupBy, so
  a hot value costs one record per task. Only observed cells are joined to
  their marginals, so no r x c grid is built, whatever the number of values.
* p-values come from a pandas UDF over the pairs table (size bounded by the
  schema); Benjamini-Hochberg is a window over that same small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tessera.columns import numeric_columns, q, text_columns
from tessera.functions.stats import chi2_sf_udf, pearson_p_udf
from tessera.operators.profile import pair_list

MIN_N = 10
FDR_MIN_TESTS = 20
PAIR_SCHEMA = "pair_idx int, feature1 string, feature2 string, correlation double, n long"


# ------------------------------------------------------------------ COR-1
def pearson_pairs(df: DataFrame, cols: list[str] | None = None, min_n: int = MIN_N,
                  with_p: bool = True) -> DataFrame:
    """r, n (complete pairs, non-finite skipped) and two-sided p for every
    pair with n >= 10; r and p rounded to 4 dp."""
    cols = cols if cols is not None else numeric_columns(df)
    pairs = pair_list(cols)
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    exprs = []
    for k, a, b in pairs:
        xa, xb = q(a).cast("double"), q(b).cast("double")
        ok = xa.isNotNull() & xb.isNotNull() & ~F.isnan(xa) & ~F.isnan(xb) & \
            (F.abs(xa) != float("inf")) & (F.abs(xb) != float("inf"))
        exprs.append(F.struct(F.lit(k).alias("pair_idx"), F.lit(a).alias("feature1"), F.lit(b).alias("feature2"),
                              F.corr(F.when(ok, xa), F.when(ok, xb)).alias("r"),
                              F.count_if(ok).alias("n")).alias(f"p{k}"))
    long = df.agg(*exprs).select(F.explode(F.array(*[F.col(f"p{k}") for k, _, _ in pairs])).alias("s")).select("s.*")
    long = long.filter((F.col("n") >= min_n) & F.col("r").isNotNull() & ~F.isnan("r"))
    cols_out = ["pair_idx", "feature1", "feature2", F.round("r", 4).alias("correlation"), "n",
                F.lit("pearson").alias("method")]
    if with_p:
        cols_out.append(F.round(pearson_p_udf(F.col("r"), F.col("n")), 4).alias("p_value"))
    return long.select(*cols_out)


# ------------------------------------------------------------- COR-2 .. 4
def contingency_cells(df: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """(pair_idx, a, b, o): observed counts of value pairs, both non-null."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("pair_idx"), q(a).cast("string").alias("a"), q(b).cast("string").alias("b"))
        for k, a, b in pairs])).alias("s")).select("s.*")
    return (long.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
                .groupBy("pair_idx", "a", "b").agg(F.count(F.lit(1)).alias("o")))


def chi_square_pairs(df: DataFrame, cols: list[str] | None = None, min_n: int = MIN_N,
                     with_p: bool = True) -> DataFrame:
    """Chi-square over all cells of each pair's table (zero cells included;
    Yates' correction when the table is 2 x 2), Cramer's V, p; pairs with
    n >= 10 and at least 2 values on each side.

    Only observed cells are joined to their marginals: an empty cell adds its
    expected count e, and all e sum to n, so together they add n less the e of
    the observed ones. In a 2 x 2 table every |o - e| is the same and 1/e sums to
    n^3 over the product of the four marginals."""
    spark = df.sparkSession
    cols = cols if cols is not None else text_columns(df)
    pairs = pair_list(cols)
    if not pairs:
        return spark.createDataFrame([], "pair_idx int, feature1 string, feature2 string, chi2 double, dof long, "
                                         "n long, n_rows int, n_cols int, cramers_v double")
    names = spark.createDataFrame(pairs, "pair_idx int, feature1 string, feature2 string")
    cells = contingency_cells(df, pairs)
    rows_m = cells.groupBy("pair_idx", "a").agg(F.sum("o").cast("double").alias("rt"))
    cols_m = cells.groupBy("pair_idx", "b").agg(F.sum("o").cast("double").alias("ct"))
    shape = (rows_m.groupBy("pair_idx").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("rt").alias("n"),
                                            (F.min("rt") * F.max("rt")).alias("r_prod"))
                   .join(cols_m.groupBy("pair_idx").agg(F.count(F.lit(1)).alias("n_cols"),
                                                        (F.min("ct") * F.max("ct")).alias("c_prod")), "pair_idx"))
    ok = shape.filter((F.col("n") >= min_n) & (F.col("n_rows") >= 2) & (F.col("n_cols") >= 2))
    e = F.col("rt") * F.col("ct") / F.col("n")
    seen = (cells.join(F.broadcast(ok), "pair_idx")  # one row per column pair
                 .join(rows_m, ["pair_idx", "a"]).join(cols_m, ["pair_idx", "b"])
                 .withColumn("e", e).withColumn("dev", F.abs(F.col("o") - F.col("e"))))
    stat = seen.groupBy("pair_idx", "n", "n_rows", "n_cols", "r_prod", "c_prod").agg(
        F.sum(F.col("dev") * F.col("dev") / F.col("e")).alias("part"), F.sum("e").alias("e_seen"),
        F.max("dev").alias("dev"), F.count(F.lit(1)).alias("n_seen"))
    n = F.col("n")
    unseen = F.when(F.col("n_seen") == F.col("n_rows") * F.col("n_cols"), 0.0).otherwise(
        F.greatest(F.lit(0.0), n - F.col("e_seen")))
    cut = F.col("dev") - F.least(F.lit(0.5), F.col("dev"))
    yates = cut * cut * n / F.col("r_prod") * n / F.col("c_prod") * n
    chi2 = F.when((F.col("n_rows") == 2) & (F.col("n_cols") == 2), yates).otherwise(F.col("part") + unseen)
    out = (stat.withColumn("chi2", chi2).join(F.broadcast(names), "pair_idx")  # one row per column pair
               .select("pair_idx", "feature1", "feature2", "chi2",
                       ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).alias("dof"), n.cast("long").alias("n"),
                       F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"),
                       F.sqrt(F.col("chi2") / (n * (F.least("n_rows", "n_cols") - 1))).alias("cramers_v")))
    if with_p:
        out = out.withColumn("p_value", chi2_sf_udf(F.col("chi2"), F.col("dof")))
    return out


# ------------------------------------------------------------------ COR-5
def fdr_bh(tests: DataFrame, p_col: str = "p_value", order_cols: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjusted p: min over k >= rank of p_(k) m / k,
    capped at 1. Ranks come from the global index (range partitions and
    offsets) and the suffix minimum is taken inside each range partition
    plus the minimum of the later partitions (one row per partition to the
    driver), so no task sees more than its own range of tests."""
    from tessera.plans.order import range_sorted, with_row_index
    order_cols = order_cols or ["test_idx"]
    spark = tests.sparkSession
    m = tests.count()
    ranked = with_row_index(tests, [p_col, *order_cols], "_rank")
    scaled = ranked.withColumn("_v", F.col(p_col) * F.lit(float(m)) / (F.col("_rank") + 1))
    rs = range_sorted(scaled, ["_rank"])
    mins = {r["_pid"]: r["mn"] for r in rs.groupBy("_pid").agg(F.min("_v").alias("mn")).collect()}
    later, run = [], None
    for pid in sorted(mins, reverse=True):   # minimum over the partitions after each one
        later.append((int(pid), run))
        run = mins[pid] if run is None else min(run, mins[pid])
    offs = spark.createDataFrame(later, "_pid int, _later double")
    w = Window.partitionBy("_pid").orderBy(F.col("_pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.min("_v").over(w)
    out = rs.join(F.broadcast(offs), "_pid")  # one row per partition
    adj = F.least(F.lit(1.0), F.least(inside, F.coalesce(F.col("_later"), F.lit(float("inf")))))
    return out.withColumn("p_adjusted", adj).drop("_pid", "_pos", "_rank", "_v", "_later")


def correlation_report(df: DataFrame, num_cols: list[str] | None = None, cat_cols: list[str] | None = None) -> DataFrame:
    """COR-1..5 together: numeric and categorical tests, BH over all p-values
    (rounded to 4 dp) when there are more than 20 tests."""
    num = pearson_pairs(df, num_cols).select("feature1", "feature2", "correlation", "p_value", "method", "n")
    cat = chi_square_pairs(df, cat_cols).select(
        "feature1", "feature2", F.round("cramers_v", 4).alias("correlation"), F.round("p_value", 4).alias("p_value"),
        F.lit("cramers_v").alias("method"), "n")
    both = num.unionByName(cat)
    rows = both.collect()  # one row per column pair; the ranking reads these and not the table again
    n_tests = len(rows)
    tests = df.sparkSession.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*both.schema.fields, StructField("test_idx", LongType())]))
    if n_tests > FDR_MIN_TESTS:
        tests = fdr_bh(tests).withColumn("p_value", F.round("p_adjusted", 4)).drop("p_adjusted")
    return tests.drop("test_idx").withColumn("fdr_applied", F.lit(n_tests > FDR_MIN_TESTS))


# ------------------------------------------------------------- COR-6 / 7
def ranked(tests: DataFrame) -> DataFrame:
    return tests.orderBy(F.desc(F.abs("correlation")), "feature1", "feature2")


def highlights(tests: DataFrame, min_abs: float = 0.25, k: int = 8) -> DataFrame:
    """Pairs with |r| >= 0.25, strongest first, at most 8."""
    return (tests.filter(F.abs("correlation") >= min_abs)
                 .orderBy(F.desc(F.abs("correlation")), "feature1", "feature2").limit(k)
                 .select("feature1", "feature2", "correlation"))


# ------------------------------------------------------------------ BIZ
# Expected relationships per domain (a, b, expectation).
EXPECTATIONS = {
    "logistics": [("transit_time", "sla_flag", "negative"), ("dwell_time", "transit_time", "positive"),
                  ("rto_flag", "sla_flag", "negative")],
    "healthcare": [("los_days", "age", "positive"), ("readmission_flag", "los_days", "unclear")],
    "retail": [("order_value", "return_flag", "none"), ("basket_size", "order_value", "positive")],
    "emarketing": [("spend", "conversions", "positive"), ("ctr", "conversion_flag", "positive")],
    "finance": [("loan_duration_days", "default_flag", "positive"), ("balance", "default_flag", "negative")],
}


def expectations_frame(spark, domain: str, custom: list[tuple[str, str, str]] | None = None) -> DataFrame:
    rows = custom if custom is not None else EXPECTATIONS.get(domain, [])
    return spark.createDataFrame(rows, "a string, b string, expected string")


def business_conflicts(tests: DataFrame, expectations: DataFrame) -> DataFrame:
    """Join tests to expectations on the unordered pair; positive and r < 0.2
    (high if r < 0 else medium); negative and r > -0.2 (high if r > 0 else
    medium); none and |r| > 0.6 medium; unclear and |r| > 0.8 low."""
    ex = expectations.select(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), "expected")
    t = tests.withColumn("_x", F.least("feature1", "feature2")).withColumn("_y", F.greatest("feature1", "feature2"))
    j = t.join(F.broadcast(ex), ["_x", "_y"])  # expectation table: a handful of rows
    r = F.col("correlation")
    sev = (F.when((F.col("expected") == "positive") & (r < 0.2), F.when(r < 0, "high").otherwise("medium"))
            .when((F.col("expected") == "negative") & (r > -0.2), F.when(r > 0, "high").otherwise("medium"))
            .when((F.col("expected") == "none") & (F.abs(r) > 0.6), "medium")
            .when((F.col("expected") == "unclear") & (F.abs(r) > 0.8), "low"))
    return (j.withColumn("conflict_severity", sev).filter(F.col("conflict_severity").isNotNull())
             .select("feature1", "feature2", F.col("correlation").alias("observed_correlation"),
                     F.col("expected").alias("expected_relationship"), "conflict_severity",
                     F.lit("pending").alias("resolution")))


def business_status(conflicts: DataFrame) -> DataFrame:
    """STOP when more than 2 high conflicts, WARN when any, else PASS."""
    return conflicts.agg(F.count_if(F.col("conflict_severity") == "high").alias("high"),
                         F.count(F.lit(1)).alias("n")).select(
        "high", "n", F.when(F.col("high") > 2, "STOP").when(F.col("n") > 0, "WARN").otherwise("PASS").alias("status"))
