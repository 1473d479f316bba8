"""Small column helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every float/double column (report presentation)."""
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def safe_div(num, den):
    """num / den with a zero or null denominator giving null (ANSI-safe)."""
    return F.try_divide(num, F.nullif(den, F.lit(0)))


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Round-robin the rows over the cluster's cores when the input lies in
    fewer files than that - only for CPU-heavy row work (regex over long texts,
    Python scoring). Inputs of many files (any large table) pass through
    untouched, so no shuffle is added there. Files are read from the plan: no
    job runs to decide, and the rows are the same either way."""
    target = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if len(df.inputFiles()) >= target else df.repartition(target)


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (an aggregate) as literals.
    The row is collected (its size is fixed by its columns), so no join -
    and no cross product - appears in the plan."""
    r = one_row.first()
    vals = r.asDict() if r is not None else {c: None for c in one_row.columns}
    types = {f.name: f.dataType for f in one_row.schema.fields}
    return df.select("*", *[F.lit(v).cast(types[k]).alias(k) for k, v in vals.items()])


def one_row(spark, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row.values())], schema)
