"""Type inference and schema (SCH-1 .. SCH-6).

Inference is one aggregate job over all rows: parse-success counts, distinct
counts and date-look counts for every text column. The result is a cast plan
applied as a pure ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.columns import is_datetime, is_numeric, is_text, q
from tessera.functions.distinct import distinct_counts

ID_FRAGMENTS = ("id", "code")
DATE_NAME_FRAGMENTS = ("date", "time", "timestamp", "ts", "dt")
DATE_VALUE_MARKS = ("/", ":", "T", "Z", "-")
NUMERIC_MIN_SHARE = 0.98
CATEGORY_MAX_DISTINCT = 50
CATEGORY_MAX_RATIO = 0.8
DATE_MIN_SHARE = 0.5  # of a text column's non-null values that look like dates
DATE_WARN = 0.02
VIOLATION_WARN = 0.02

PLAN_SCHEMA = ("position int, column string, source_type string, target_type string, role string, "
               "failures long, warning string")


# text that can parse as a number at all (the guard keeps the parser off
# obviously non-numeric text, where failed parses are expensive)
NUMERIC_LOOK = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:nan|inf|infinity)\s*$"


def _to_double(c: Column) -> Column:
    """Text to double the way the reference coerces: '%' removed, failures null."""
    s = F.replace(c.cast("string"), F.lit("%"), F.lit(""))
    return F.when(s.rlike(NUMERIC_LOOK), s.try_cast("double"))


def _to_ts(c: Column) -> Column:
    return c.cast("string").try_cast("timestamp")


def name_is_id(name: str) -> bool:
    low = name.lower()
    return any(f in low for f in ID_FRAGMENTS)


def name_is_date(name: str) -> bool:
    low = name.lower()
    return any(f in low for f in DATE_NAME_FRAGMENTS)


def _looks_like_date(c: Column) -> Column:
    """SCH-2 by value: a digit, one of - / : T Z, and readable as a time."""
    marks = "[" + "".join(DATE_VALUE_MARKS) + "]"
    return F.coalesce(c.rlike("[0-9]") & c.rlike(marks) & _to_ts(c).isNotNull(), F.lit(False))


def infer_plan(df: DataFrame, date_min_share: float = DATE_MIN_SHARE) -> DataFrame:
    """SCH-1/2/3: the cast plan, one row per column, first rule that hits:
    id/code name -> string; text named like a date, or with at least
    ``date_min_share`` of its non-null values looking like dates -> timestamp
    (failures null; warn over 2 %); text numeric (after removing '%') in
    >= 98 % of all rows -> double; text with < 50 distinct values and
    distinct/rows <= 0.8 -> category; other text -> string; integers -> double."""
    spark = df.sparkSession
    fields = df.schema.fields
    texts = [f.name for f in fields if is_text(f.dataType) and not name_is_id(f.name)]
    exprs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(texts):
        exprs += [F.count_if(_to_double(q(c)).isNotNull()).alias(f"num{i}"),
                  F.count_if(q(c).isNotNull() & _to_ts(q(c)).isNull()).alias(f"tsfail{i}"),
                  F.count_if(_looks_like_date(q(c))).alias(f"look{i}"),
                  F.count_if(q(c).isNull()).alias(f"z{i}")]
    stats = df.agg(*exprs).first()  # one row, bounded by the schema
    n = stats["_n"] or 0
    distinct = distinct_counts(df, [q(c) for c in texts])
    rows = []
    for pos, f in enumerate(fields):
        c, dt_ = f.name, f.dataType
        src = dt_.simpleString()
        if name_is_id(c):
            rows.append((pos, c, src, "string", "id", 0, None))
            continue
        if is_text(dt_):
            i = texts.index(c)
            filled = n - stats[f"z{i}"]
            if name_is_date(c) or (filled and stats[f"look{i}"] / filled >= date_min_share):
                fails = stats[f"tsfail{i}"] + stats[f"z{i}"]
                warn = f"{fails} datetime conversion failures" if n and fails / n > DATE_WARN else None
                rows.append((pos, c, src, "timestamp", "datetime", int(stats[f"tsfail{i}"]), warn))
                continue
            if n and stats[f"num{i}"] / n >= NUMERIC_MIN_SHARE:
                rows.append((pos, c, src, "double", "numeric", int(n - stats[f"num{i}"] - stats[f"z{i}"]), None))
                continue
            d = distinct[i]
            if n and d < CATEGORY_MAX_DISTINCT and d / n <= CATEGORY_MAX_RATIO:
                rows.append((pos, c, src, "category", "categorical", 0, None))
            else:
                rows.append((pos, c, src, "string", "text", 0, None))
            continue
        if is_datetime(dt_):
            rows.append((pos, c, src, src, "datetime", 0, None))
        elif isinstance(dt_, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            rows.append((pos, c, src, "double", "numeric", 0, None))
        elif is_numeric(dt_):
            rows.append((pos, c, src, src, "numeric", 0, None))
        else:
            rows.append((pos, c, src, src, "other", 0, None))
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def apply_plan(df: DataFrame, plan: list) -> DataFrame:
    """Pure select of casts; categorical columns carry {"role": "categorical"}."""
    by_col = {r["column"]: r for r in plan}
    out = []
    for c in df.columns:
        tgt = by_col[c]["target_type"]
        src = by_col[c]["source_type"]
        x = q(c)
        if tgt == src:
            out.append(x.alias(c))
        elif tgt == "string":
            out.append(x.cast("string").alias(c))
        elif tgt == "category":
            out.append(x.cast("string").alias(c, metadata={"role": "categorical"}))
        elif tgt == "timestamp":
            out.append(_to_ts(x).alias(c))
        elif tgt == "double":
            out.append((_to_double(x) if src == "string" else x.cast("double")).alias(c))
        else:
            out.append(x.alias(c))
    return df.select(*out)


def infer_and_cast(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    plan = infer_plan(df)
    return apply_plan(df, plan.collect()), plan


# ------------------------------------------------------------------ SCH-3
def column_roles(df: DataFrame) -> DataFrame:
    """id / datetime / numeric / categorical (string with < 50 distinct and
    distinct/rows < 0.5); text columns failing that get no role."""
    spark = df.sparkSession
    texts = [f.name for f in df.schema.fields if is_text(f.dataType) and not name_is_id(f.name)
             and f.metadata.get("role") != "categorical"]
    stats = df.agg(F.count(F.lit(1)).alias("_n"),
                   *[F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(texts)]).first()
    n = stats["_n"] or 0
    rows = []
    for pos, f in enumerate(df.schema.fields):
        c = f.name
        if name_is_id(c):
            role = "id"
        elif is_datetime(f.dataType):
            role = "datetime"
        elif is_numeric(f.dataType):
            role = "numeric"
        elif f.metadata.get("role") == "categorical":
            role = "categorical"
        elif c in texts:
            d = stats[f"d{texts.index(c)}"]
            role = "categorical" if (n and d < CATEGORY_MAX_DISTINCT and d / n < 0.5) else None
        else:
            role = None
        if role:
            rows.append((pos, c, role))
    return spark.createDataFrame(rows, "position int, column string, role string")


# ------------------------------------------------------------------ SCH-4
def schema_table(df: DataFrame) -> DataFrame:
    """dtype and nullable (= any null present) per column; unique is false."""
    wide = df.agg(*[F.max(q(c).isNull().cast("int")).alias(f"z{i}") for i, c in enumerate(df.columns)])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 (F.coalesce(F.col(f"z{i}"), F.lit(0)) == 1).alias("nullable"), F.lit(False).alias("unique"))
        for i, c in enumerate(df.columns)])).alias("r")).select("r.*")


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


# ------------------------------------------------------------------ SCH-5
NAME_RULES = [  # fixed values: (fragments, target), first hit wins
    (("id", "key", "code", "ref"), "string"),
    (("date", "time", "ts", "created", "updated"), "timestamp"),
    (("amount", "price", "value", "count", "rate", "pct", "ratio"), "double"),
    (("status", "type", "category", "flag", "gender", "department"), "category"),
]


def name_target(name: str, dt_: T.DataType) -> str:
    low = name.lower()
    for frags, tgt in NAME_RULES:
        if any(f in low for f in frags):
            return tgt
    if is_numeric(dt_):
        return "double"
    if is_datetime(dt_):
        return "timestamp"
    return "string"


def enforce_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name-driven casts; failures become null. Returns (table, conversions)."""
    spark = df.sparkSession
    out, conv = [], []
    for pos, f in enumerate(df.schema.fields):
        c, src = f.name, f.dataType.simpleString()
        tgt = name_target(c, f.dataType)
        x = q(c)
        if tgt == "string":
            e = x.cast("string")
        elif tgt == "timestamp":
            e = x if is_datetime(f.dataType) else _to_ts(x)
            e = e.cast("timestamp")
        elif tgt == "double":
            e = x.cast("double") if is_numeric(f.dataType) or isinstance(f.dataType, T.BooleanType) \
                else x.cast("string").try_cast("double")
        else:  # category
            e = x.cast("string")
        md = {"role": "categorical"} if tgt == "category" else {}
        out.append(e.alias(c, metadata=md))
        conv.append((pos, c, src, tgt))
    return df.select(*out), spark.createDataFrame(conv, "position int, column string, source_type string, target_type string")


# ------------------------------------------------------------------ SCH-6
def schema_violations(df: DataFrame) -> DataFrame:
    """Nulls in id-named columns, plus nulls in datetime and numeric columns
    (an id-named numeric column counts twice), over rows x columns; WARN when
    the rate > 0.02."""
    n_cols = len(df.columns)
    parts = []
    for f in df.schema.fields:
        z = F.count_if(q(f.name).isNull())
        w = int("id" in f.name.lower()) + int(is_datetime(f.dataType)) + int(is_numeric(f.dataType))
        if w:
            parts.append(z * w)
    viol = sum(parts, F.lit(0)) if parts else F.lit(0)
    n = F.count(F.lit(1))
    rate = viol / (n * n_cols)
    return df.agg(n.alias("total_rows"), F.lit(n_cols).alias("total_columns"),
                  viol.cast("long").alias("schema_violations"), rate.alias("violation_rate")) \
             .withColumn("status", F.when(F.col("violation_rate") > VIOLATION_WARN, "WARN").otherwise("OK"))
