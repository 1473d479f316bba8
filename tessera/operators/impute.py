"""Missing-data handling (IMP-1 .. IMP-14).

Decisions are taken on the original table from one aggregate (null counts,
and - only when the chained-regression rule can fire - one correlation
aggregate). Fills are column expressions plus, for group fills, a per-group
aggregate joined back on the group key (AQE broadcasts it when its measured
size is small; otherwise a shuffle join, with skew splitting).
Validation (PSI, KS) compares original and imputed distributions with
bounded literals (decile edges) and distributed prefix sums.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import is_datetime, is_numeric, numeric_columns, q
from tessera.functions.quantiles import exact_quantiles, grouped_exact_quantiles
from tessera.functions.util import safe_div, with_row
from tessera.functions.two_sample import two_sample
from tessera.plans.order import prefix_sums

LOW_MISSING = 0.05
GROUP_MAX_MISSING = 0.50
MICE_MIN_ROWS = 50000
MICE_MIN_PEERS = 3
PEER_CORR = 0.4
SMALL_ROWS = 2000
MID_ROWS = 10000
PSI_PASS = 0.10
KS_PASS = 0.10
COMPLETENESS_STOP = 0.80

DECISION_SCHEMA = "position int, column string, method string, reason string, missing_before long, missing_pct double"


# ------------------------------------------------------------- IMP-1 / 2
def _correlated_peers(df: DataFrame, cols: list[str], threshold: float = PEER_CORR) -> dict[str, int]:
    """Per numeric column: other numeric columns with |r| >= threshold (one aggregate)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return {c: 0 for c in cols}
    row = df.agg(*[F.corr(q(a).cast("double"), q(b).cast("double")).alias(f"r{k}")
                   for k, (a, b) in enumerate(pairs)]).first()
    peers = {c: 0 for c in cols}
    for k, (a, b) in enumerate(pairs):
        r = row[f"r{k}"]
        if r is not None and abs(r) >= threshold:
            peers[a] += 1
            peers[b] += 1
    return peers


@dataclass
class _Facts:
    """What the rules may ask about a column with nulls."""
    kind: str           # time, number or other
    share: float        # of nulls
    rows: int
    grouped: bool       # the group column exists
    group_named: bool   # a group column was asked for
    peers: Callable[[], int]


# IMP-1 as a table: (kind, condition, method, reason); the first row that holds decides
RULES: list[tuple[str, Callable[[_Facts], bool], Callable[[_Facts], str], Callable[[_Facts], str]]] = [
    ("time", lambda f: True, lambda f: "flag_only", lambda f: "dates are never imputed"),
    ("number", lambda f: f.share <= LOW_MISSING, lambda f: "median", lambda f: "low missing share"),
    ("number", lambda f: f.grouped and f.share <= GROUP_MAX_MISSING, lambda f: "group_median", lambda f: "group structure present"),
    ("number", lambda f: f.rows >= MICE_MIN_ROWS and f.peers() >= MICE_MIN_PEERS, lambda f: "mice", lambda f: f"{f.peers()} correlated peers, large table"),
    ("number", lambda f: f.rows < SMALL_ROWS, lambda f: "group_median" if f.grouped else "median", lambda f: "small table"),
    ("number", lambda f: f.rows < MID_ROWS, lambda f: "group_median" if f.group_named else "median", lambda f: "mid-size table"),
    ("number", lambda f: True, lambda f: "knn", lambda f: "dense locality"),
    ("other", lambda f: f.share <= LOW_MISSING, lambda f: "mode", lambda f: "low missing share"),
    ("other", lambda f: f.grouped, lambda f: "group_mode", lambda f: "group structure present"),
    ("other", lambda f: True, lambda f: "unknown", lambda f: "high missing share"),
]


def decide_methods(df: DataFrame, group_col: str | None = None, knn_max_rows: int | None = None) -> DataFrame:
    """IMP-1: one decision row per column with nulls, first rule that hits. With
    ``knn_max_rows`` a larger table takes the median where the rules say kNN (off by
    default: kNN visits few cells a row and runs on any size)."""
    cols = df.columns
    st = df.agg(F.count(F.lit(1)).alias("_n"),
                *[F.count_if(q(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)]).first()
    n, known = st["_n"] or 0, {}

    def peers(column: str) -> Callable[[], int]:
        def ask() -> int:
            if not known:
                known.update(_correlated_peers(df, numeric_columns(df)))
            return known.get(column, 0)
        return ask

    rows = []
    for i, c in enumerate(cols):
        z = st[f"z{i}"]
        if not z:
            continue
        dt_ = df.schema[c].dataType
        facts = _Facts("time" if is_datetime(dt_) else "number" if is_numeric(dt_) else "other", z / n, n,
                       bool(group_col) and group_col in cols, bool(group_col), peers(c))
        method, why = next((m(facts), r(facts)) for kind, holds, m, r in RULES if kind == facts.kind and holds(facts))
        if method == "knn" and knn_max_rows is not None and n > knn_max_rows:
            method, why = "median", f"more than {knn_max_rows} rows"
        rows.append((i, c, method, why, int(z), float(z / n)))
    return df.sparkSession.createDataFrame(rows, DECISION_SCHEMA)


# ------------------------------------------------------------- IMP-3 .. 8
def flag_missing(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(f"{col}_missing", q(col).isNull().cast("int"))


def medians(df: DataFrame, cols: list[str], exact: bool = True) -> dict[str, float | None]:
    """Medians of several columns: exact via distributed running counts
    (no task holds a column's distinct values), or a bounded sketch."""
    if not cols:
        return {}
    if exact:
        return {c: v[0] for c, v in exact_quantiles(df, cols, [0.5]).items()}
    row = df.agg(*[F.percentile_approx(q(c).cast("double"), F.lit(0.5), F.lit(10000)).cast("double").alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(cols)}


def impute_median(df: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    med = medians(df, cols, exact)
    return df.select(*[F.coalesce(q(c).cast("double"), F.lit(med[c])).alias(c) if c in med else q(c)
                       for c in df.columns])


def impute_group_median(df: DataFrame, col: str, group: str, exact: bool = True) -> DataFrame:
    """Median per group fills the group's nulls; what is left (all-null
    groups, null group) gets the median of the already filled column."""
    x = q(col).cast("double")
    if exact:  # distributed: a hot group's values are not gathered in one task
        per_group = grouped_exact_quantiles(df.filter(q(group).isNotNull()), [group], col, [0.5], ["_gm"]) \
            .withColumnRenamed(group, "_g")
    else:
        per_group = df.groupBy(q(group).alias("_g")).agg(
            F.percentile_approx(x, F.lit(0.5), F.lit(10000)).cast("double").alias("_gm"))
    j = df.join(per_group, q(group) == F.col("_g"), "left")  # null groups match nothing
    filled = j.withColumn(col, F.coalesce(x, F.col("_gm"))).drop("_g", "_gm")
    rest = medians(filled, [col], exact)[col]
    return filled.withColumn(col, F.coalesce(q(col), F.lit(rest)))


def _mode_of(df: DataFrame, col: str) -> str | None:
    """Most frequent non-null value (smallest on tie), one bounded result."""
    r = (df.filter(q(col).isNotNull()).groupBy(q(col).cast("string").alias("_v"))
           .agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "_v").limit(1).collect())
    return r[0]["_v"] if r else None


def impute_mode(df: DataFrame, col: str) -> DataFrame:
    m = _mode_of(df, col)
    return df.withColumn(col, F.coalesce(q(col).cast("string"), F.lit(m if m is not None else "Unknown")))


def impute_group_mode(df: DataFrame, col: str, group: str) -> DataFrame:
    """Mode per group (smallest on tie; 'Unknown' for a group without
    values), then the mode of the filled column for what is left."""
    counts = (df.filter(q(col).isNotNull() & q(group).isNotNull())
                .groupBy(q(group).alias("_g"), q(col).cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    w = Window.partitionBy("_g").orderBy(F.desc("_n"), "_v")
    modes = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select("_g", F.col("_v").alias("_gm"))
    j = df.join(modes, q(group) == F.col("_g"), "left")
    fill = F.when(q(group).isNotNull(), F.coalesce(F.col("_gm"), F.lit("Unknown")))
    filled = j.withColumn(col, F.coalesce(q(col).cast("string"), fill)).drop("_g", "_gm")
    m = _mode_of(filled, col)
    return filled.withColumn(col, F.coalesce(q(col), F.lit(m if m is not None else "Unknown")))


def impute_unknown(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(q(col).cast("string"), F.lit("Unknown")))


# ------------------------------------------------------------ IMP-11 PSI
def decile_edges(df: DataFrame, col: str, bins: int = 10) -> list[float]:
    """Distinct linear percentiles 0, 1/bins, ..., 1 of the non-null values."""
    ps = [i / bins for i in range(bins + 1)]
    r = exact_quantiles(df, [col], ps)[col]
    return sorted(set(r)) if r and r[0] is not None else []


def bin_index(x: Column, edges: list[float]) -> Column:
    """numpy.histogram binning: [e_i, e_i+1) with the last bin closed;
    outside the edges -> null."""
    k = len(edges) - 1
    expr = F.lit(None).cast("int")
    for i in range(k - 1, -1, -1):
        lo, hi = edges[i], edges[i + 1]
        cond = (x >= lo) & ((x <= hi) if i == k - 1 else (x < hi))
        expr = F.when(cond, F.lit(i)).otherwise(expr)
    return expr


def psi(original: DataFrame, col_a: str, current: DataFrame, col_b: str, bins: int = 10,
        edges: list[float] | None = None) -> DataFrame:
    """Population stability index of ``current`` against ``original``:
    bins from the original's distinct deciles; shares over all non-null
    values (outside values count in the denominator only); 0 share ->
    0.0001; sum (new - old) ln(new / old). One row: psi, n_bins."""
    spark = original.sparkSession
    edges = edges if edges is not None else decile_edges(original, col_a, bins)
    if len(edges) < 2:
        return spark.createDataFrame([(0.0, 0)], "psi double, n_bins int")
    a = original.select(q(col_a).cast("double").alias("x")).filter(F.col("x").isNotNull())
    b = current.select(q(col_b).cast("double").alias("x")).filter(F.col("x").isNotNull())
    k = len(edges) - 1

    def shares(d: DataFrame) -> DataFrame:
        # each row's bin computed once, counted by a small groupBy
        per = d.groupBy(F.coalesce(bin_index(F.col("x"), edges), F.lit(-1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("k"))
        return with_row(per, per.agg(F.sum("k").alias("n"))).select("bin", (F.col("k") / F.col("n")).alias("share"))

    grid = spark.range(k).select(F.col("id").cast("int").alias("bin"))
    j = (grid.join(shares(a).withColumnRenamed("share", "pa"), "bin", "left")
             .join(shares(b).withColumnRenamed("share", "pb"), "bin", "left"))
    pa = F.coalesce(F.col("pa"), F.lit(0.0))
    pb = F.coalesce(F.col("pb"), F.lit(0.0))
    pa = F.when(pa == 0, F.lit(0.0001)).otherwise(pa)
    pb = F.when(pb == 0, F.lit(0.0001)).otherwise(pb)
    return j.agg(F.sum((pb - pa) * F.log(pb / pa)).alias("psi")).select("psi", F.lit(k).alias("n_bins"))


# ------------------------------------------------------------- IMP-12 KS
def ks_statistic(a: DataFrame, col_a: str, b: DataFrame, col_b: str) -> DataFrame:
    """Two-sample KS: max |F1 - F2| over all values. Counts per distinct
    value (map-side combined), then distributed running sums (SURVEY 7.4)."""
    xa = a.select(q(col_a).cast("double").alias("v")).filter(F.col("v").isNotNull()) \
          .select("v", F.lit(1).alias("c1"), F.lit(0).alias("c2"))
    xb = b.select(q(col_b).cast("double").alias("v")).filter(F.col("v").isNotNull()) \
          .select("v", F.lit(0).alias("c1"), F.lit(1).alias("c2"))
    per_value = xa.unionByName(xb).groupBy("v").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    tot = per_value.agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))
    cum = prefix_sums(per_value, ["v"], ["c1", "c2"])
    return (with_row(cum, tot)
               .agg(F.max(F.abs(F.col("cum_c1") / F.col("n1") - F.col("cum_c2") / F.col("n2"))).alias("ks")))


# ------------------------------------------------------------ IMP-13 / 14
@dataclass
class ImputeResult:
    """Imputed table and decisions; validation, completeness and status are
    computed on request (validation runs extra jobs per column)."""
    original: DataFrame
    data: DataFrame
    decisions: DataFrame
    numeric_imputed: list
    _validated: DataFrame | None = None

    def validation(self) -> DataFrame:
        if self._validated is None:  # one row per column: asked for again by the status
            self._validated = validate(self.original, self.data, self.numeric_imputed)
        return self._validated

    def completeness(self) -> DataFrame:
        return completeness(self.data)

    def status(self) -> str:
        vrows = self.validation().collect()
        c = self.completeness().first()["record_completeness"]
        failed = sum(1 for v in vrows if not v["passed"])
        return "STOP" if c < COMPLETENESS_STOP or failed > len(vrows) * 0.3 else "WARN" if failed else "PASS"


def apply_decisions(df: DataFrame, decisions: list, group_col: str | None = None, exact: bool = True,
                    knn_k: int = 5) -> DataFrame:
    out = df
    med_cols = [d["column"] for d in decisions if d["method"] == "median"]
    if med_cols:
        out = impute_median(out, med_cols, exact)
    for d in decisions:
        c, m = d["column"], d["method"]
        if m == "flag_only":
            out = flag_missing(out, c)
        elif m == "group_median":
            out = (impute_group_median(out, c, group_col, exact) if group_col and group_col in out.columns
                   else impute_median(out, [c], exact))
        elif m == "mode":
            out = impute_mode(out, c)
        elif m == "group_mode":
            out = impute_group_mode(out, c, group_col)
        elif m == "unknown":
            out = impute_unknown(out, c)
        elif m in ("knn", "mice"):
            from tessera.operators import impute_models
            nums = numeric_columns(out)
            out = (impute_models.knn_impute(out, nums, k=knn_k) if m == "knn"
                   else impute_models.chained_regression(out, nums))
    return out


def validate(original: DataFrame, imputed: DataFrame, cols: list[str], min_n: int = 10) -> DataFrame:
    """PSI and KS per imputed numeric column with >= 10 values on both sides;
    pass when PSI <= 0.10 and KS <= 0.10."""
    spark = original.sparkSession
    held = imputed.select(*[q(c) for c in cols]).persist() if cols else imputed  # read by every pass, imputed once
    try:
        rows = [(c, float(t.psi), float(t.ks), bool(t.psi <= PSI_PASS and t.ks <= KS_PASS))
                for c, t in two_sample(original, held, cols).items() if min(t.n_a, t.n_b) >= min_n]
    finally:
        if cols:
            held.unpersist()
    out = spark.createDataFrame(rows, "column string, psi double, ks_statistic double, passed boolean")
    return out.select("column", F.round("psi", 4).alias("psi"), F.round("ks_statistic", 4).alias("ks_statistic"),
                      "passed")


def completeness(df: DataFrame) -> DataFrame:
    """1 - nulls / (rows x columns), 4 dp (flag columns included)."""
    cols = df.columns
    z = sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0))
    return df.agg(F.round(1 - safe_div(z, F.count(F.lit(1)) * len(cols)), 4).alias("record_completeness"))


def run_imputation(df: DataFrame, group_col: str | None = None, exact: bool = True) -> ImputeResult:
    decisions = decide_methods(df, group_col)
    drows = decisions.collect()  # one row per column with nulls
    imputed = apply_decisions(df, drows, group_col, exact)
    nums = numeric_columns(df)
    num_imputed = [d["column"] for d in drows if d["column"] in nums and d["method"] != "flag_only"]
    return ImputeResult(df, imputed, decisions, num_imputed)
