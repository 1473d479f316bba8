"""Standardisation (STD-1 .. STD-4).

NFC has no Spark built-in: it runs in an Arrow UDF, and only for
rows that are not pure ASCII (ASCII is already NFC), so the common case
stays inside whole-stage codegen. Letter folding and value maps are
built-in ``translate`` / map lookups. Rare-category collapse joins per-value
counts back; the rare set is broadcast only when its measured size is
under a limit, otherwise it is a shuffle join.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.columns import categorical_columns, q

# ASCII and the Latin-1 letters / signs from U+00C0 are already NFC and NFKC
# (no decomposition, no compatibility mapping): such text skips the UDF.
ASCII_ONLY = r"^[\x00-\x7F]*$"
NORMALIZATION_STABLE = r"^[\x00-\x7F\x{C0}-\x{FF}]*$"

# Arabic letter folding (STD-2): alef forms to bare alef,
# alef maksura to ya, ta marbuta to ha.
ARABIC_FROM = "إأآٱىة"
ARABIC_TO = "اااايه"

# Domain value maps (STD-3), exact key first, then lower-cased.
VALUE_MAPS = {
    "logistics": {
        "carrier": {"dhl": "DHL", "DHL Express": "DHL", "aramex": "Aramex", "ARAMEX": "Aramex",
                    "smsa": "SMSA", "SMSA Express": "SMSA"},
        "status": {"delivered": "Delivered", "DELIVERED": "Delivered", "in_transit": "In Transit",
                   "IN_TRANSIT": "In Transit", "pending": "Pending", "returned": "Returned"},
    },
    "healthcare": {
        "department": {"emergency": "Emergency", "ER": "Emergency", "icu": "ICU", "intensive care": "ICU",
                       "surgery": "Surgery", "surgical": "Surgery"},
    },
    "retail": {
        "payment_method": {"credit_card": "Credit Card", "cc": "Credit Card", "debit": "Debit Card",
                           "cash_on_delivery": "COD", "cod": "COD"},
    },
}

SLICE_ROWS = 256        # texts that are Python strings at once
KEPT_LIMIT = 10_000     # values of a column that are written as literals
HOT_SHARE = 1_000       # a value with more than 1 / HOT_SHARE of the rows is not shuffled


def _mapped(s: pa.Array, work: Callable[[str], str]) -> pa.Array:
    """``work`` on each text, a slice at a time: only a slice's texts are Python strings."""
    parts = [pa.array([None if x is None else work(x) for x in s.slice(lo, SLICE_ROWS).to_pylist()], pa.string()) for lo in range(0, len(s), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(T.StringType())
def _nfc_udf(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: unicodedata.normalize("NFC", x))


@F.arrow_udf(T.StringType())
def _nfkc_udf(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: unicodedata.normalize("NFKC", x))


@F.arrow_udf(T.StringType())
def _strip_marks_udf(s: pa.Array) -> pa.Array:
    return _mapped(s, lambda x: "".join(ch for ch in unicodedata.normalize("NFD", x) if unicodedata.category(ch) != "Mn"))


def _ascii_guard(c: Column, udf, stable: str = ASCII_ONLY) -> Column:
    # a Python UDF runs on every row, also those its branch does not take: these give it null
    still = c.isNull() | c.rlike(stable)
    return F.when(still, c).otherwise(udf(F.when(~still, c)))


def nfc(c: Column) -> Column:
    return _ascii_guard(c, _nfc_udf, NORMALIZATION_STABLE)


def nfkc(c: Column) -> Column:
    return _ascii_guard(c, _nfkc_udf, NORMALIZATION_STABLE)


def strip_marks(c: Column) -> Column:
    """NFD, then drop nonspacing marks (category Mn); not recomposed."""
    return _ascii_guard(c, _strip_marks_udf)


def arabic_fold(c: Column) -> Column:
    return F.translate(c, ARABIC_FROM, ARABIC_TO)


def map_values(c: Column, mapping: dict[str, str]) -> Column:
    """Exact key, then lower-cased key, else unchanged."""
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    s = c.cast("string")
    return F.coalesce(m[s], m[F.lower(s)], s)


def normalize_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """STD-1 + STD-2 on text columns."""
    cols = cols if cols is not None else categorical_columns(df)
    return df.select(*[arabic_fold(nfc(q(c))).alias(c) if c in cols else q(c) for c in df.columns])


def apply_domain_maps(df: DataFrame, domain: str) -> DataFrame:
    maps = VALUE_MAPS.get(domain, {})
    return df.select(*[map_values(q(c), maps[c]).alias(c) if c in maps else q(c) for c in df.columns])


def collapse_rare(df: DataFrame, cols: list[str] | None = None, threshold: float = 0.01,
                  most_kept: int = KEPT_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Values whose share (null counts as a value) is <= the threshold become
    'Other' (null stays null). With <= 1000 rows the threshold is at least
    0.03. Returns (table, report of values collapsed per column).

    All columns are counted in one (column, value) aggregate. The values that stay
    are fewer than 1 / threshold, so they are literals and no row is joined or
    moved, however hot a value is; for a threshold below 1 / ``most_kept`` the rare
    values are joined instead, hot ones left out of the shuffle."""
    spark = df.sparkSession
    cols = cols if cols is not None else categorical_columns(df)
    if not cols:
        return df, spark.createDataFrame([], "column string, n_collapsed long, threshold double")
    n = df.count()
    eff = 0.03 if (n <= 1000 and threshold < 0.03) else threshold
    cells = F.array(*[F.struct(F.lit(i).alias("i"), q(c).cast("string").alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(cells).alias("s")).groupBy("s.i", "s.v").agg(F.count(F.lit(1)).alias("n"))
    rare = F.col("n") / F.lit(max(n, 1)) <= eff
    literal = eff * most_kept >= 1
    if not literal:
        counts = counts.checkpoint()
    per = {r["i"]: r for r in counts.groupBy("i").agg(F.count_if(rare).alias("rare"), *([F.collect_list(F.when(~rare, F.col("v"))).alias("kept")] if literal else []))
           .collect()}
    out = df
    for i, c in enumerate(cols):
        if i not in per or not per[i]["rare"]:
            continue
        x, text = q(c), q(c).cast("string")
        if literal:
            kept = per[i]["kept"]
            out = out.withColumn(c, F.when(x.isNull() | text.isin(kept), x).otherwise(F.lit("Other")) if kept else F.when(x.isNotNull(), F.lit("Other")))
        else:
            values = counts.filter((F.col("i") == i) & F.col("v").isNotNull()).select("v", rare.alias("_rare"))
            hot = [r["v"] for r in values.filter(~F.col("_rare")).join(counts.filter(F.col("n") > n / HOT_SHARE).filter(F.col("i") == i).select("v"), "v", "left_semi").select("v").collect()]
            gone = values.filter("_rare").select(F.col("v").alias("_rv"), "_rare")
            some = out.filter(text.isNotNull() & ~text.isin(hot)) if hot else out.filter(text.isNotNull())
            rest = out.filter(text.isNull() | text.isin(hot)) if hot else out.filter(text.isNull())
            done = some.join(gone, text == F.col("_rv"), "left").withColumn(c, F.when(F.col("_rare"), F.lit("Other")).otherwise(x)).drop("_rv", "_rare")
            out = rest.unionByName(done)
    report = [(c, int(per[i]["rare"]) if i in per else 0, float(eff)) for i, c in enumerate(cols)]
    return out, spark.createDataFrame(report, "column string, n_collapsed long, threshold double")


def standardize(df: DataFrame, domain: str = "logistics", rare_threshold: float = 0.01,
                cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    cols = cols if cols is not None else categorical_columns(df)
    out = normalize_text(df, cols)
    out = apply_domain_maps(out, domain)
    return collapse_rare(out, cols, rare_threshold)
