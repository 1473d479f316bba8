"""Drift check of a current table against a baseline (MON-2), batch form.

Per numeric column: PSI with the baseline's decile bins and the two-sample
KS statistic; status act / warn / ok by the monitoring thresholds. All
columns share one sorted table of counts (``functions.two_sample``), so each side
is read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.columns import numeric_columns
from tessera.functions.two_sample import two_sample
from tessera.operators.signals import KS_ACT, KS_WARN, PSI_ACT, PSI_WARN


def drift_status(p: F.Column, k: F.Column) -> F.Column:
    return (F.when((p > PSI_ACT) | (k > KS_ACT), "act").when((p > PSI_WARN) | (k > KS_WARN), "warn")
             .otherwise("ok"))


def drift_check(baseline: DataFrame, current: DataFrame, cols: list[str] | None = None,
                min_n: int = 10, bins: int = 10) -> DataFrame:
    spark = baseline.sparkSession
    cols = cols if cols is not None else [c for c in numeric_columns(baseline) if c in current.columns]
    found = {c: t for c, t in two_sample(baseline, current, cols, bins).items() if t.n_a >= min_n}
    out = spark.createDataFrame([(c, float(t.psi), float(t.ks or 0.0)) for c, t in found.items()], "feature string, psi double, ks double")
    return out.select("feature", F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"),
                      drift_status(F.col("psi"), F.col("ks")).alias("status"))
