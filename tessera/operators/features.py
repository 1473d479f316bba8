"""Derived features (FEA-1 .. FEA-12): pure column expressions, one ``select``.

A feature is made only if its inputs exist. Caps are counted in one
aggregate. Row-local work only: no shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.columns import ntz_literal, q

# Outlier caps per domain.
CAPS = {"logistics": {"transit_time": 240.0, "dwell_time": 72.0}, "healthcare": {"los_days": 365.0}}
SLA_HOURS = 48


def _micros(c: Column) -> Column:
    """Epoch microseconds of a timestamp / timestamp_ntz / date / text column."""
    return F.unix_micros(c.cast("timestamp"))


def hours_between(start: Column, end: Column) -> Column:
    return (_micros(end) - _micros(start)) / 3.6e9


def days_between(start: Column, end: Column) -> Column:
    return (_micros(end) - _micros(start)) / 8.64e10


def flag(cond: Column) -> Column:
    """Boolean to 0/1 with null -> 0 (pandas comparisons with NaN are False)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def contains_flag(c: Column, word: str) -> Column:
    return flag(F.lower(c.cast("string")).contains(word))


def age_group(age: Column) -> Column:
    """(0,18] Child, (18,40] Adult, (40,60] Middle, (60,100] Senior, else null."""
    a = age.cast("double")
    return (F.when((a > 0) & (a <= 18), "Child").when((a > 18) & (a <= 40), "Adult")
             .when((a > 40) & (a <= 60), "Middle").when((a > 60) & (a <= 100), "Senior"))


def derive_features(df: DataFrame, domain: str = "logistics",
                    as_of: dt.datetime | None = None) -> tuple[DataFrame, list[tuple]]:
    """Returns the table with derived columns and the feature specs (FEA-12)."""
    cols = set(df.columns)
    specs: list[tuple] = []
    out = df
    if domain == "logistics":
        if {"pickup_date", "delivery_date"} <= cols:
            out = out.withColumn("transit_time", hours_between(q("pickup_date"), q("delivery_date")))
            specs.append(("transit_time", "Hours between pickup and delivery", "double",
                          "(delivery_date - pickup_date) in hours"))
        if "transit_time" in out.columns:
            out = out.withColumn("sla_flag", flag(q("transit_time") <= SLA_HOURS))
            specs.append(("sla_flag", "1 if delivered within 48h SLA", "int", "transit_time <= 48"))
        if "status" in cols:
            out = out.withColumn("rto_flag", contains_flag(q("status"), "return"))
            specs.append(("rto_flag", "1 if shipment returned to origin", "int", "status contains 'return'"))
    elif domain == "healthcare":
        if {"admission_ts", "discharge_ts"} <= cols:
            out = out.withColumn("los_days", days_between(q("admission_ts"), q("discharge_ts")))
            specs.append(("los_days", "Length of stay in days", "double", "(discharge_ts - admission_ts) in days"))
        if "age" in cols:
            out = out.withColumn("age_group", age_group(q("age")))
            specs.append(("age_group", "Age category", "string", "cut(age, [0,18,40,60,100])"))
    elif domain == "retail":
        if {"quantity", "price"} <= cols:
            out = out.withColumn("order_value", q("quantity").cast("double") * q("price").cast("double"))
            specs.append(("order_value", "Total order amount", "double", "quantity * price"))
        if "return_flag" not in cols and "status" in cols:
            out = out.withColumn("return_flag", contains_flag(q("status"), "return"))
            specs.append(("return_flag", "1 if order returned", "int", "status contains 'return'"))
    elif domain == "emarketing":
        if {"clicks", "impressions"} <= cols:
            out = out.withColumn("ctr", F.try_divide(q("clicks").cast("double"),
                                                      F.nullif(q("impressions").cast("double"), F.lit(0.0))))
            specs.append(("ctr", "Click-through rate", "double", "clicks / impressions"))
        if "conversions" in cols:
            out = out.withColumn("conversion_flag", flag(q("conversions") > 0))
            specs.append(("conversion_flag", "1 if at least one conversion", "int", "conversions > 0"))
    elif domain == "finance":
        if "open_date" in cols:
            ref = ntz_literal(as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)).cast("timestamp")
            out = out.withColumn("loan_duration_days",
                                 F.floor((F.unix_micros(ref) - _micros(q("open_date"))) / 8.64e10).cast("double"))
            specs.append(("loan_duration_days", "Days since loan opened", "double", "(today - open_date).days"))
        if "default_flag" in cols:
            out = out.withColumn("overdue_flag", q("default_flag"))
            specs.append(("overdue_flag", "Copy of default_flag", "int", "default_flag"))
    return out, specs


def cap_outliers(df: DataFrame, domain: str = "logistics") -> tuple[DataFrame, DataFrame]:
    """Clip capped columns from above (nulls stay null); report the number of
    values above each cap (one aggregate), rows only where > 0."""
    caps = {c: v for c, v in CAPS.get(domain, {}).items() if c in df.columns}
    spark = df.sparkSession
    if not caps:
        return df, spark.createDataFrame([], "column string, cap_value double, n_capped long")
    out = df
    for c, v in caps.items():
        out = out.withColumn(c, F.when(q(c) > v, F.lit(v)).otherwise(q(c).cast("double")))
    counts = df.agg(*[F.count_if(q(c) > v).alias(f"c{i}") for i, (c, v) in enumerate(caps.items())])
    rep = counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(float(v)).alias("cap_value"), F.col(f"c{i}").alias("n_capped"))
        for i, (c, v) in enumerate(caps.items())])).alias("r")).select("r.*").filter(F.col("n_capped") > 0)
    return out, rep


def feature_draft(df: DataFrame, domain: str = "logistics", as_of: dt.datetime | None = None):
    """FEA-1..12: derive, cap, and return (table, spec table, caps report)."""
    out, specs = derive_features(df, domain, as_of)
    out, caps = cap_outliers(out, domain)
    spec_df = df.sparkSession.createDataFrame(
        [(n, d, t, der) for n, d, t, der in specs],
        "name string, description string, dtype string, derivation string")
    # a spec is marked capped only when some value was above its cap
    spec_df = (spec_df.join(F.broadcast(caps), spec_df.name == caps.column, "left")
                      .select("name", "description", "dtype", "derivation",
                              F.col("n_capped").isNotNull().alias("capped"), "cap_value"))
    return out, spec_df, caps
