"""KPIs (KPI-1 .. KPI-7).

Every KPI of a request compiles to aggregate Column expressions, and all of
them run in ONE ``agg`` (one scan); ratios and multipliers are arithmetic on
the one-row result.
"""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.columns import datetime_columns, numeric_columns, q, resolve_column, text_columns
from tessera.functions.constants import DOMAIN_KEYWORDS

# ---------------------------------------------------------------- KPI-1
# KPI registry per domain: (name, kind, source column).
# kind: pct = mean of a 0/1 flag x 100; avg; sum; avg_pct = mean x 100; total = rows.
KPI_REGISTRY = {
    "logistics": [("sla_pct", "pct", "sla_flag"), ("rto_pct", "pct", "rto_flag"),
                  ("fas_pct", "pct", "fas_flag"), ("avg_transit_h", "avg", "transit_time"),
                  ("total_shipments", "total", None)],
    "healthcare": [("avg_los_days", "avg", "los_days"), ("readmission_30d_pct", "pct", "readmission_flag"),
                   ("bed_occupancy_pct", "pct", "bed_occupied_flag"), ("total_admissions", "total", None)],
    "emarketing": [("ctr_pct", "avg_pct", "ctr"), ("conversion_pct", "pct", "conversion_flag"),
                   ("cac", "avg", "cac"), ("roas", "avg", "roas"), ("total_campaigns", "total", None)],
    "retail": [("gmv", "sum", "order_value"), ("aov", "avg", "order_value"),
               ("return_pct", "pct", "return_flag"), ("basket_size", "avg", "basket_size"),
               ("total_orders", "total", None)],
    "finance": [("npl_pct", "pct", "default_flag"), ("avg_balance", "avg", "balance"),
                ("liquidity_ratio", "avg", "liquidity_ratio"), ("total_accounts", "total", None)],
}


def kpi_exprs(df: DataFrame, domain: str) -> list[Column]:
    spec = KPI_REGISTRY.get(domain, KPI_REGISTRY["logistics"])
    out = []
    for name, kind, col in spec:
        if kind == "total":
            out.append(F.count(F.lit(1)).alias(name))
            continue
        if col not in df.columns:
            out.append(F.lit(None).cast("double").alias(name))
            continue
        x = q(col).cast("double")
        e = {"pct": F.avg(x) * 100, "avg": F.avg(x), "sum": F.sum(x), "avg_pct": F.avg(x) * 100}[kind]
        out.append(e.cast("double").alias(name))
    return out


def compute_kpis(df: DataFrame, domain: str) -> DataFrame:
    """One row of the domain's KPIs; a KPI whose column is absent is null."""
    return df.agg(*kpi_exprs(df, domain))


# ------------------------------------------------------------ KPI-3 / KPI-4
def filter_mask(df: DataFrame, column: str | None, flt: dict | None) -> Column | None:
    """Filter spec -> boolean Column. not_equals and not_in keep nulls, as
    pandas' ``!=`` does; comparisons coerce text to numbers (failures null)."""
    if not flt:
        return None
    target = flt.get("column") or column
    if not target:
        return None
    target = resolve_column(df.columns, target)
    if target is None:
        return None
    s = q(target)
    num = F.expr(f"try_cast(`{target}` AS DOUBLE)")
    op = flt.get("operator", "equals")
    val = flt.get("value")
    vals = flt.get("values")
    if vals is not None and not isinstance(vals, list):
        vals = [vals]
    if op == "equals":
        return F.coalesce(s == F.lit(val), F.lit(False))
    if op == "not_equals":
        return ~s.eqNullSafe(F.lit(val))
    if op == "in":
        return F.coalesce(s.isin(vals or []), F.lit(False))
    if op == "not_in":
        return F.coalesce(~s.isin(vals or []), F.lit(True)) if vals else F.lit(True)
    if op in ("gt", "gte", "lt", "lte"):
        c = {"gt": num > val, "gte": num >= val, "lt": num < val, "lte": num <= val}[op]
        return F.coalesce(c, F.lit(False))
    if op == "between":
        lo, hi = (vals if vals and len(vals) == 2 else flt.get("range") or [flt.get("lower"), flt.get("upper")])
        return F.coalesce((num >= lo) & (num <= hi), F.lit(False))
    if op == "exists":
        return s.isNotNull()
    if op == "not_exists":
        return s.isNull()
    raise ValueError(f"unknown filter operator {op!r}")


def _median_input(df: DataFrame, spec: dict) -> Column:
    col = resolve_column(df.columns, spec["column"])
    if col is None:
        raise ValueError(f"Column '{spec['column']}' not found for aggregation.")
    mask = filter_mask(df, col, spec.get("filter"))
    x = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    return F.when(mask, x) if mask is not None else x


def exact_medians(df: DataFrame, specs: list[dict]) -> list[float | None]:
    """Medians of several filtered columns from one distributed exact
    quantile job (no task gathers a column's values)."""
    from tessera.functions.quantiles import exact_quantiles
    if not specs:
        return []
    cols = [f"_med{i}" for i in range(len(specs))]
    frame = df.select(*[_median_input(df, sp).alias(c) for sp, c in zip(specs, cols)])
    qs = exact_quantiles(frame, cols, [0.5])
    return [qs[c][0] for c in cols]


def aggregation_expr(df: DataFrame, spec: dict, medians: dict | None = None) -> Column:
    """count / sum / mean / median / nunique of a column under a filter."""
    agg = spec.get("aggregation", "count")
    col = spec.get("column")
    if col:
        rc = resolve_column(df.columns, col)
        if rc is None:
            raise ValueError(f"Column '{col}' not found for aggregation.")
        col = rc
    mask = filter_mask(df, col, spec.get("filter"))
    keep = mask if mask is not None else F.lit(True)
    if agg == "count":
        if col:
            return F.count(F.when(keep, q(col))).cast("double")
        return F.count_if(keep).cast("double")
    if not col:
        raise ValueError(f"aggregation {agg} needs a column")
    x = F.when(keep, F.expr(f"try_cast(`{col}` AS DOUBLE)"))
    if agg == "sum":
        return F.coalesce(F.sum(x), F.lit(0.0))
    if agg == "mean":
        return F.avg(x)
    if agg == "median":
        if medians is not None and id(spec) in medians:
            return F.lit(medians[id(spec)]).cast("double")
        return F.percentile(x, F.lit(0.5))
    if agg == "nunique":
        return F.count_distinct(F.when(keep, q(col))).cast("double")
    raise ValueError(f"Unsupported aggregation '{agg}'.")


# ------------------------------------------------------------------ KPI-5
def evaluate_formulas(df: DataFrame, kpis: dict[str, dict]) -> DataFrame:
    """Evaluate named formulas in one aggregate; one row per KPI:
    (kpi, value, status, formatted, reason).

    ratio: numerator / denominator x multiplier, zero or null denominator
    gives 0 (``clamp_zero``) or null (``skip_on_zero``); single value:
    aggregation x multiplier."""
    spark = df.sparkSession
    exprs, plan, failures = [], [], {}
    # medians first (exact, distributed); they enter the one aggregate as literals
    med_specs = []
    for f in kpis.values():
        for part in ("numerator", "denominator", "aggregation"):
            sp = (f or {}).get(part)
            if sp and sp.get("aggregation") == "median" and sp.get("column") \
                    and resolve_column(df.columns, sp["column"]) is not None:
                med_specs.append(sp)
    medians = {id(sp): v for sp, v in zip(med_specs, exact_medians(df, med_specs))}
    for i, (name, f) in enumerate(kpis.items()):
        try:
            if not f:
                raise ValueError("no formula")
            if f.get("type") == "ratio":
                exprs += [aggregation_expr(df, f["numerator"], medians).alias(f"n{i}"),
                          aggregation_expr(df, f["denominator"], medians).alias(f"d{i}")]
            else:
                exprs.append(aggregation_expr(df, f["aggregation"], medians).alias(f"n{i}"))
            plan.append((i, name, f))
        except ValueError as e:
            failures[name] = str(e)
    rows = []
    if exprs:
        wide = df.agg(*exprs)
        for i, name, f in plan:
            mult = float(f.get("multiplier", 1.0))
            if f.get("type") == "ratio":
                num, den = F.col(f"n{i}"), F.col(f"d{i}")
                zero = F.lit(0.0) if f.get("guard_rail", "clamp_zero") == "clamp_zero" else F.lit(None).cast("double")
                val = F.when(den.isNull() | (den == 0), zero).otherwise(num / den * mult)
                fmt = "percentage"
                is_ratio = True
            else:
                val = F.col(f"n{i}") * mult
                fmt = f.get("format", "number")
                is_ratio = False
            rows.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("kpi"),
                                 val.cast("double").alias("value"), F.lit(fmt).alias("_fmt"),
                                 F.lit(is_ratio).alias("_ratio")))
        # one scan: every KPI is a field of the same one-row aggregate
        out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    else:
        out = spark.createDataFrame([], "position int, kpi string, value double, _fmt string, _ratio boolean")
    v = F.col("value")
    formatted = (F.when(v.isNull(), F.lit(None))
                 .when(F.col("_fmt") == "percentage", F.concat(F.format_number(v, 2), F.lit("%")))
                 .when(F.col("_fmt") == "currency", F.concat(F.lit("$"), F.format_number(v, 2)))
                 .otherwise(F.format_number(v, 2)))
    status = (F.when(v.isNull(), "fail").when(F.col("_ratio") & (v == 0), "warn").otherwise("pass"))
    reason = (F.when(v.isNull(), "value could not be computed")
              .when(F.col("_ratio") & (v == 0), "ratio evaluated to zero"))
    out = out.select("position", "kpi", "value", status.alias("status"), formatted.alias("formatted"),
                     reason.alias("reason"))
    if failures:
        names = list(kpis)
        fail = spark.createDataFrame(
            [(names.index(k), k, None, "fail", None, msg) for k, msg in failures.items()],
            "position int, kpi string, value double, status string, formatted string, reason string")
        out = out.unionByName(fail)
    return out


# ------------------------------------------------------------------ KPI-7
def adopt(spark, table: str, name: str, formula: dict, adopted_at: dt.datetime | None = None) -> DataFrame:
    """Append an adopted KPI definition (JSON text) to a definitions table."""
    import json
    row = spark.createDataFrame(
        [(name, json.dumps(formula, sort_keys=True), adopted_at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))],
        "kpi string, formula string, adopted_at timestamp_ntz")
    row.write.mode("append").saveAsTable(table)
    return spark.table(table)


def adopted_formulas(spark, table: str) -> dict[str, dict]:
    """Latest definition per KPI name (a small definitions table)."""
    import json
    rows = (spark.table(table).groupBy("kpi").agg(F.max_by("formula", "adopted_at").alias("formula"))
            .collect())
    return {r["kpi"]: json.loads(r["formula"]) for r in rows}


# ------------------------------------------------------------------ KPI-2
# Column-name fragments and value words for KPIs found by search.
SLA_FRAGMENTS = ["delivery_status", "status", "completed", "success", "delivered"]
SLA_SUCCESS_WORDS = ["delivered", "completed", "success", "on-time"]
TRANSIT_FRAGMENTS = ["transit", "delivery_time", "duration", "time", "days"]
RTO_FRAGMENTS = ["return", "rto", "failed", "undelivered", "rejected"]
RTO_PATTERN = "return|rto|failed"
LOS_FRAGMENTS = ["los", "length_of_stay", "stay_duration", "days"]
READMIT_FRAGMENTS = ["readmission", "readmit", "return_visit"]
READMIT_PATTERN = "yes|true|1"
REVENUE_FRAGMENTS = ["sales", "revenue", "amount", "price", "value", "total"]
RETURN_FRAGMENTS = ["return", "refund", "exchange"]
RETURN_PATTERN = "return|refund"


def _first_by_fragments(cols: list[str], fragments: list[str]) -> str | None:
    for frag in fragments:
        for c in cols:
            if frag.lower() in c.lower():
                return c
    return None


def detect_domain(columns: list[str]) -> str:
    """Keyword domain detection (DOM-4) on the driver from column names."""
    low = [c.lower() for c in columns]
    scores = {d: sum(1 for k in kws if any(k in c for c in low)) for d, kws in DOMAIN_KEYWORDS.items()}
    best = max(scores, key=scores.get)
    return best if scores[best] > 0 else "generic"


def search_kpis(df: DataFrame, domain: str) -> DataFrame:
    """KPIs by column-name search, one aggregate. Where the reference invents a
    figure (no matching column) we return null and a reason instead.
    Output: long table (kpi, value, source_column, reason)."""
    cols = df.columns
    nums = numeric_columns(df)
    texts = set(text_columns(df))
    dates = datetime_columns(df)
    n = F.count(F.lit(1)).cast("double")
    items: list[tuple[str, Any, str | None, str | None]] = [
        ("total_records", n, None, None), ("total_columns", F.lit(float(len(cols))), None, None)]

    def share_text(c, pattern):
        return F.count_if(F.coalesce(F.lower(q(c)).rlike(pattern), F.lit(False))) / n * 100

    def missing_rate():
        return sum((F.count_if(q(c).isNull()) for c in cols), F.lit(0)) / (n * len(cols)) * 100

    d = domain.lower()
    detected = detect_domain(cols)
    if d == "logistics" or detected == "logistics":
        items.append(("total_shipments", n, None, None))
        c = _first_by_fragments(cols, SLA_FRAGMENTS)
        if c and c in texts:
            succ = sum((F.count_if(F.coalesce(F.lower(q(c)).contains(w), F.lit(False))) for w in SLA_SUCCESS_WORDS),
                       F.lit(0))
            items.append(("sla_pct", succ / n * 100, c, None))
        elif c:
            items.append(("sla_pct", F.sum(q(c).cast("double")) / n * 100, c, None))
        else:
            items.append(("sla_pct", F.lit(None).cast("double"), None, "no status column"))
        c = _first_by_fragments(nums, TRANSIT_FRAGMENTS)
        if c:
            items.append(("avg_transit_h", F.avg(q(c).cast("double")), c, None))
        elif len(dates) > 1:
            a, b = dates[0], dates[1]
            diff = (F.unix_micros(q(b).cast("timestamp")) - F.unix_micros(q(a).cast("timestamp"))) / 3.6e9
            items.append(("avg_transit_h", F.avg(diff), f"{a}->{b}", None))
        else:
            items.append(("avg_transit_h", F.lit(None).cast("double"), None, "no transit column"))
        c = _first_by_fragments(cols, RTO_FRAGMENTS)
        if c and c in texts:
            items.append(("rto_pct", share_text(c, RTO_PATTERN), c, None))
        elif c:
            items.append(("rto_pct", F.sum(q(c).cast("double")) / n * 100, c, None))
        else:
            items.append(("rto_pct", F.lit(None).cast("double"), None, "no return column"))
    elif d == "healthcare" or detected == "healthcare":
        items.append(("total_admissions", n, None, None))
        c = _first_by_fragments(nums, LOS_FRAGMENTS)
        items.append(("avg_los_days", F.avg(q(c).cast("double")) if c else F.lit(None).cast("double"), c,
                      None if c else "no length-of-stay column"))
        c = _first_by_fragments(cols, READMIT_FRAGMENTS)
        if c and c in texts:
            items.append(("readmission_30d_pct", share_text(c, READMIT_PATTERN), c, None))
        elif c:
            items.append(("readmission_30d_pct", F.sum(q(c).cast("double")) / n * 100, c, None))
        else:
            items.append(("readmission_30d_pct", F.lit(None).cast("double"), None, "no readmission column"))
    elif d == "retail" or detected == "retail":
        items.append(("total_orders", n, None, None))
        c = _first_by_fragments(nums, REVENUE_FRAGMENTS)
        if c:
            items += [("gmv", F.sum(q(c).cast("double")), c, None), ("aov", F.avg(q(c).cast("double")), c, None)]
        else:
            items += [("gmv", F.lit(None).cast("double"), None, "no revenue column"),
                      ("aov", F.lit(None).cast("double"), None, "no revenue column")]
        c = _first_by_fragments(cols, RETURN_FRAGMENTS)
        if c and c in texts:
            items.append(("return_pct", share_text(c, RETURN_PATTERN), c, None))
        elif c:
            items.append(("return_pct", F.sum(q(c).cast("double")) / n * 100, c, None))
        else:
            items.append(("return_pct", F.lit(None).cast("double"), None, "no return column"))
    else:
        comp = 100 - missing_rate()
        items += [("data_quality_score", comp, None, None), ("completeness_rate", comp, None, None)]
        uniq = sum((F.count_distinct(q(c)) for c in cols), F.lit(0))
        items.append(("unique_values_ratio", uniq / (n * len(cols)) * 100, None, None))
    wide = df.agg(*[e.cast("double").alias(f"k{i}") for i, (_, e, _, _) in enumerate(items)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(k).alias("kpi"), F.col(f"k{i}").alias("value"),
                 F.lit(src).cast("string").alias("source_column"), F.lit(why).cast("string").alias("reason"))
        for i, (k, _, src, why) in enumerate(items)])).alias("r")).select("r.*")
