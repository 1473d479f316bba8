"""Quality gate (QC-1 .. QC-9).

Fixes (empty rows/columns, header clean-up, duplicate rows) run first, then
the scans. Every scan is one aggregate over all columns; the date-order scan
is one range-partitioned pass (SURVEY 7.4) with boundary comparisons added
from one summary row per partition.
"""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.columns import datetime_columns, is_datetime, ntz_literal, q
from tessera.functions.util import safe_div, with_row
from tessera.sources.landing import land_parquet, scratch_path

MISSING_WARN = 0.20
INVERSION_WARN = 0.005
KEY_STOP = 0.10

SEVERITY_RANK = {"PASS": 0, "WARN": 1, "STOP": 2}


# --------------------------------------------------------------- QC-1..QC-4
def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without a single value (one aggregate, one row to the driver)."""
    if not df.columns:
        return []
    row = df.agg(*[F.count(q(c)).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[str(i)] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    empty = empty_columns(df)
    return df.drop(*empty) if empty else df


def clean_header_name(name: str) -> str:
    return str(name).strip().replace("\n", " ").replace("\r", "")


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header_name(c) for c in df.columns])


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication (nulls equal); map-side combined, so a hot
    duplicated row costs one record per task before the shuffle."""
    return df.dropDuplicates()


def auto_fix(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """QC-1..4 in the reference's order; returns (clean, fixes report)."""
    spark = df.sparkSession
    empty = empty_columns(df)
    step1 = drop_empty_rows(df)
    step2 = step1.drop(*empty) if empty else step1
    step3 = clean_headers(step2)
    step4 = drop_duplicate_rows(step3)
    # row counts for the report come from one aggregate each (lazy until used)
    fixes = spark.createDataFrame(
        [("empty_columns_removed", len(empty)),
         ("headers_changed", sum(1 for a, b in zip(step2.columns, step3.columns) if a != b))],
        "fix string, n long")
    return step4, fixes


def _all_null(df: DataFrame):
    cond = F.lit(True)
    for c in df.columns:
        cond = cond & q(c).isNull()
    return cond


def fix_counts(df: DataFrame) -> DataFrame:
    """Rows removed as empty and as whole-row duplicates, by aggregate."""
    non_empty = drop_empty_rows(df)
    n_all = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~_all_null(df)).alias("n_non_empty"))
    n_distinct = non_empty.dropDuplicates().agg(F.count(F.lit(1)).alias("n_distinct"))
    return (with_row(n_all, n_distinct)
            .select((F.col("n") - F.col("n_non_empty")).alias("empty_rows_removed"),
                    (F.col("n_non_empty") - F.col("n_distinct")).alias("duplicate_rows_removed"),
                    F.col("n_distinct").alias("rows_after")))


# ------------------------------------------------------------------ QC-5
def missing_scan(df: DataFrame, digits: int = 4) -> DataFrame:
    """(column, missing_pct, status); status WARN when the share > 0.20."""
    cols = df.columns
    agg = df.agg(*[F.avg(q(c).isNull().cast("double")).alias(str(i)) for i, c in enumerate(cols)])
    long = agg.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(str(i)).alias("pct"))
        for i, c in enumerate(cols)])).alias("r")).select("r.*")
    return long.select("position", "column", F.round("pct", digits).alias("missing_pct"),
                       F.when(F.col("pct") > MISSING_WARN, "WARN").otherwise("PASS").alias("status"))


# ------------------------------------------------------------------ QC-6
def future_dates(df: DataFrame, as_of: dt.datetime, cols: list[str] | None = None) -> DataFrame:
    """Per datetime column: values after ``as_of`` and their share of all rows."""
    cols = cols if cols is not None else datetime_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, future_dates long, future_pct double")
    lit_ts = ntz_literal(as_of)
    exprs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        exprs.append(F.count_if(q(c).cast("timestamp_ntz") > lit_ts).alias(str(i)))
    agg = df.agg(*exprs)
    long = agg.select("_n", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("future_dates"))
        for i, c in enumerate(cols)])).alias("r")).select("_n", "r.*")
    return long.select("column", "future_dates",
                       F.round(safe_div(F.col("future_dates"), F.col("_n")), 4).alias("future_pct"))


# ------------------------------------------------------------------ QC-7
def _as_double(df: DataFrame, c: str):
    dt_ = df.schema[c].dataType
    if is_datetime(dt_):
        return F.unix_micros(q(c).cast("timestamp")).cast("double")
    return q(c).cast("double")


def _descent_summary(pdf_iter, cols):
    """Per partition and column: non-null count, descents inside the
    partition, and the first and last non-null value (sorted input)."""
    state = {c: [0, 0, None, None] for c in cols}  # n, desc, first, last
    pid = None
    for pdf in pdf_iter:
        if len(pdf) == 0:
            continue
        pid = int(pdf["_pid"].iloc[0])
        for c in cols:
            v = pdf[c].dropna().to_numpy()
            if len(v) == 0:
                continue
            st = state[c]
            if st[3] is not None and v[0] < st[3]:
                st[1] += 1
            st[1] += int((v[1:] < v[:-1]).sum())
            st[0] += len(v)
            if st[2] is None:
                st[2] = float(v[0])
            st[3] = float(v[-1])
    if pid is None:
        return
    yield pd.DataFrame({"_pid": [pid] * len(cols), "column": cols,
                        "n": [state[c][0] for c in cols], "desc": [state[c][1] for c in cols],
                        "first": [state[c][2] for c in cols], "last": [state[c][3] for c in cols]})


def date_inversions(df: DataFrame, order_cols: list[str], cols: list[str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Per column: among non-null values in ``order_cols`` order, the count of
    values smaller than their predecessor; share of the non-null count; WARN
    when the share > 0.005. ``order_cols`` should be unique (add the key)."""
    spark = df.sparkSession
    cols = cols if cols is not None else datetime_columns(df)
    if not cols:
        return spark.createDataFrame([], "column string, inversions long, non_null long, "
                                         "inversion_pct double, status string")
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [f"v{i}" for i in range(len(cols))]
    proj = df.select(*[q(c) for c in order_cols],
                     *[_as_double(df, c).alias(nm) for c, nm in zip(cols, names)])
    srt = (proj.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
               .withColumn("_pid", F.spark_partition_id()).select("_pid", *names))
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("column", T.StringType()),
                           T.StructField("n", T.LongType()), T.StructField("desc", T.LongType()),
                           T.StructField("first", T.DoubleType()), T.StructField("last", T.DoubleType())])
    summ = srt.mapInPandas(lambda it: _descent_summary(it, names), schema)
    # one row per (partition, column): the boundary pass is a window over a
    # table whose size is partitions x columns, independent of the data.
    from pyspark.sql.window import Window
    w = Window.partitionBy("column").orderBy("_pid")
    prev_last = F.last("last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = summ.withColumn("_boundary", F.when(F.col("first") < prev_last, 1).otherwise(0))
    agg = b.groupBy("column").agg((F.sum("desc") + F.sum("_boundary")).cast("long").alias("inversions"),
                                  F.sum("n").cast("long").alias("non_null"))
    mapping = spark.createDataFrame(list(zip(names, cols, range(len(cols)))), "column string, name string, position int")
    out = agg.join(F.broadcast(mapping), "column").select(
        "position", F.col("name").alias("column"), "inversions", "non_null",
        F.round(F.coalesce(F.col("inversions") / F.nullif(F.col("non_null"), F.lit(0)), F.lit(0.0)), 4)
        .alias("inversion_pct"),
        F.when(F.col("inversions") / F.col("non_null") > INVERSION_WARN, "WARN").otherwise("PASS").alias("status"))
    return out


# ------------------------------------------------------------------ QC-8
def key_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: rows beyond the first of each value (nulls equal one another)
    and null keys, each over all rows; STOP when either share > 0.10 or the
    key column is missing."""
    spark = df.sparkSession
    present = [k for k in keys if k in df.columns]
    rows = []
    if present:
        exprs = [F.count(F.lit(1)).alias("_n")]
        for i, k in enumerate(present):
            exprs += [F.count_distinct(q(k)).alias(f"d{i}"), F.count_if(q(k).isNull()).alias(f"z{i}")]
        agg = df.agg(*exprs)
        parts = []
        for i, k in enumerate(present):
            dups = F.col("_n") - F.col(f"d{i}") - F.when(F.col(f"z{i}") > 0, 1).otherwise(0)
            parts.append(F.struct(F.lit(k).alias("key"), dups.cast("long").alias("duplicates"),
                                  F.col(f"z{i}").cast("long").alias("nulls")))
        rows_df = agg.select("_n", F.explode(F.array(*parts)).alias("r")).select("_n", "r.*")
        dpct = safe_div(F.col("duplicates"), F.col("_n"))
        npct = safe_div(F.col("nulls"), F.col("_n"))
        res = rows_df.select(
            "key", "duplicates", F.round(dpct, 4).alias("duplicates_pct"), "nulls",
            F.round(npct, 4).alias("nulls_pct"),
            F.when((dpct > KEY_STOP) | (npct > KEY_STOP), "STOP").otherwise("PASS").alias("status"))
        rows.append(res)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        rows.append(spark.createDataFrame(
            [(k, None, None, None, None, "STOP") for k in missing],
            "key string, duplicates long, duplicates_pct double, nulls long, nulls_pct double, status string"))
    if not rows:
        return spark.createDataFrame([], "key string, duplicates long, duplicates_pct double, "
                                         "nulls long, nulls_pct double, status string")
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------------ QC-9
def overall_status(*reports: DataFrame) -> DataFrame:
    """STOP if any report row says STOP, else WARN if any says WARN, else PASS."""
    spark = reports[0].sparkSession
    sev = spark.createDataFrame(list(SEVERITY_RANK.items()), "status string, rank int")
    u = None
    for r in reports:
        s = r.select("status")
        u = s if u is None else u.unionByName(s)
    return (u.join(F.broadcast(sev), "status")
             .agg(F.max_by("status", "rank").alias("status"))
             .select(F.coalesce("status", F.lit("PASS")).alias("status")))


def run_quality_control(df: DataFrame, keys: list[str] | None = None, order_cols: list[str] | None = None,
                        as_of: dt.datetime | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """Fixes, then scans; returns the cleaned table and every report. The cleaned
    table is written once (to ``path``, else to a scratch folder): every scan reads
    it, and no scan shuffles the rows for duplicates again."""
    clean, fixes = auto_fix(df)
    if clean.columns:
        path = land_parquet(clean, path or scratch_path(df.sparkSession, "clean"))
        clean = df.sparkSession.read.schema(clean.schema).parquet(path)
    out = {"data": clean, "fixes": fixes, "missing": missing_scan(clean)}
    out["future"] = future_dates(clean, as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    if order_cols:
        out["dates"] = date_inversions(clean, order_cols)
    out["keys"] = key_check(clean, keys or [])
    reports = [out["missing"], out["keys"]] + ([out["dates"]] if order_cols else [])
    out["status"] = overall_status(*reports)
    return out
