"""Split, encode, scale (SPL-1 .. SPL-4, ENC-1 .. ENC-4, SCL-1 .. SCL-3).

Splits give exact counts without moving the rows: the cut points are values of
a seeded hash (or of the time) found by rank over that narrow column, and each row
is compared with them; only rows that tie at a cut are sorted. Encoders and scalers are fitted to
small parameter frames (per-category statistics, per-column moments) and
applied with ``select`` plus joins on the category (AQE decides broadcast
from measured size).
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import categorical_columns, is_numeric, q
from tessera.functions.quantiles import exact_quantiles, select_ranks
from tessera.plans.order import prefix_sums, with_row_index

SEED = 42
TEST_SIZE = 0.15
VAL_SIZE = 0.15
OHE_MAX = 50
TARGET_MIN_ROWS = 50000
TE_SMOOTHING = 1.0
TE_MIN_LEAF = 20
STRATA_BROADCAST_MAX = 100_000


def _hash_key(df: DataFrame, key_cols: list[str], seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), *[q(c) for c in key_cols])


def _cut(df: DataFrame, order: F.Column, sizes, names: list[str], tie_cols: list[str]) -> DataFrame:
    """Adds ``split``: rows in the order of ``order`` (a long) fall into ``names`` by
    ``sizes(n)``, the last gets the rest. The cut points are found by rank over the
    narrow order column, the rows are compared with them as literals and stay where
    they are; only rows that tie at a cut are numbered, by ``tie_cols``."""
    found, (n,) = select_ranks(df, [order], lambda _, n: list(itertools.accumulate(sizes(n))), "long")
    ends = list(itertools.accumulate(sizes(n)))
    label, ties = F.lit(names[-1]), {}
    for name, end in reversed(list(zip(names, ends))):
        if end < n:
            value, below, _ = found[0, end]  # the first row that is not in it
            label = F.when(order < value, name).otherwise(label)
            if end > below:
                ties.setdefault(value, below)
        else:
            label = F.lit(name)
    out = df.withColumn("split", label)
    for value, below in ties.items():
        tied = with_row_index(out.filter(order == value), tie_cols, "_i")
        place, again = F.col("_i") + below, F.lit(names[-1])
        for name, end in reversed(list(zip(names, ends))):
            again = F.when(place < end, name).otherwise(again)
        out = out.filter(order != value).unionByName(tied.withColumn("split", again).drop("_i"))
    return out


def _random_sizes(n: int, test_size: float, val_size: float) -> tuple[int, int]:
    n_test = math.ceil(test_size * n)
    return n_test, math.ceil(val_size / (1 - test_size) * (n - n_test))


# ---------------------------------------------------------------- SPL-1
def random_split(df: DataFrame, key_cols: list[str], test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
                 seed: int = SEED) -> DataFrame:
    """Adds ``split`` in {train, validation, test}: test = ceil(test_size n)
    rows, validation = ceil(val/(1-test) x rest), by seeded-hash order of
    the key (repeatable, exact counts)."""
    return _cut(df, _hash_key(df, key_cols, seed), lambda n: _random_sizes(n, test_size, val_size), ["test", "validation", "train"], key_cols)


# ---------------------------------------------------------------- SPL-2
def _allocate(strata: DataFrame, size_col: str, total: int, name: str) -> DataFrame:
    """Largest-remainder allocation of ``total`` over the rows of ``strata`` by
    their share of ``size_col``, as column ``name``; equal remainders in the
    order of the value as text. Strata may be many: they stay in Spark."""
    n = strata.agg(F.sum(size_col)).first()[0] or 0
    raw = F.lit(float(total)) * F.col(size_col) / F.lit(float(n or 1))
    whole = strata.withColumn(name, F.least(F.col(size_col), F.floor(raw)))
    left = total - (whole.agg(F.sum(name)).first()[0] or 0)
    ranked = with_row_index(whole.withColumn("_rest", F.floor(raw) - raw).withColumn("_label", F.col("_t").cast("string")),
                            ["_rest", "_label"], "_k")
    more = (F.col("_k") < F.lit(left)) & (F.col(name) < F.col(size_col))
    return ranked.withColumn(name, F.col(name) + more.cast("long")).drop("_rest", "_label", "_k")


def stratified_split(df: DataFrame, target: str, key_cols: list[str], test_size: float = TEST_SIZE,
                     val_size: float = VAL_SIZE, seed: int = SEED) -> DataFrame:
    """Same cut inside each target value. Each stratum's two cut points come from
    running counts over the narrow (target, hash), so a stratum holding a third
    of the rows is spread over many tasks; the rows are compared with their
    stratum's cut points. Rows that tie at one are numbered by key."""
    h = _hash_key(df, key_cols, seed)
    narrow = df.select(q(target).alias("_t"), h.alias("_h")).groupBy("_t", "_h").agg(F.count(F.lit(1)).alias("_c"))
    strata = df.groupBy(q(target).alias("_t")).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n = strata.agg(F.sum("_n")).first()[0] or 0
    n_test, n_val = _random_sizes(n, test_size, val_size)
    alloc = _allocate(strata, "_n", n_test, "_nt").withColumn("_left", F.col("_n") - F.col("_nt"))
    alloc = prefix_sums(_allocate(alloc, "_left", n_val, "_nv"), ["_t"], ["_n"])  # nulls first, as in the running counts
    alloc = alloc.select("_t", (F.col("cum__n").cast("long") - F.col("_n")).alias("_start"), "_nt", (F.col("_nt") + F.col("_nv")).alias("_nv"))
    few = alloc.count() <= STRATA_BROADCAST_MAX  # one row per stratum, size checked
    sized = F.broadcast(alloc) if few else alloc

    def same(a: DataFrame, b: DataFrame):
        return a["_t"].eqNullSafe(b["_s"])

    # of each stratum the hash at which each cut falls, and the rows below it
    run = prefix_sums(narrow, ["_t", "_h"], ["_c"])
    run = run.join(sized.withColumnRenamed("_t", "_s"), run["_t"].eqNullSafe(F.col("_s")))
    last, first = F.col("cum__c").cast("long") - F.col("_start"), F.col("cum__c").cast("long") - F.col("_start") - F.col("_c")

    def at(cut: str):
        return F.min(F.when((first <= F.col(cut)) & (F.col(cut) < last), F.struct(F.col("_h").alias("h"), first.alias("below"))))

    cuts = run.groupBy("_t").agg(at("_nt").alias("_ct"), at("_nv").alias("_cv"), F.first("_nt").alias("_nt"), F.first("_nv").alias("_nv")) \
              .withColumnRenamed("_t", "_s").checkpoint()
    j = df.join(F.broadcast(cuts) if few else cuts, q(target).eqNullSafe(F.col("_s"))).withColumn("_h", h)
    # no row at a cut: the cut lies at the stratum's end
    split = (F.when(F.col("_ct").isNull() | (F.col("_h") < F.col("_ct.h")), "test")
             .when(F.col("_cv").isNull() | (F.col("_h") < F.col("_cv.h")), "validation").otherwise("train"))
    partly = cuts.filter("_ct.below < _nt or _cv.below < _nv")
    out = j.withColumn("split", split)
    if not partly.isEmpty():
        tie = (F.col("_ct").isNotNull() & (F.col("_h") == F.col("_ct.h"))) | (F.col("_cv").isNotNull() & (F.col("_h") == F.col("_cv.h")))
        tied = with_row_index(j.filter(tie), [target, "_h", *key_cols], "_i")
        least = tied.groupBy(q(target).alias("_u"), F.col("_h").alias("_g")).agg(F.min("_i").alias("_from"))
        tied = tied.join(least, q(target).eqNullSafe(F.col("_u")) & (F.col("_h") == F.col("_g")))
        here = F.when(F.col("_ct.h") == F.col("_h"), F.col("_ct.below")).otherwise(F.col("_cv.below"))
        place = F.col("_i") - F.col("_from") + here
        tied = tied.withColumn("split", F.when(place < F.col("_nt"), "test").when(place < F.col("_nv"), "validation").otherwise("train"))
        out = out.filter(~tie).unionByName(tied.drop("_i", "_u", "_g", "_from"))
    return out.drop("_h", "_s", "_ct", "_cv", "_nt", "_nv")


# ---------------------------------------------------------------- SPL-3
def time_split(df: DataFrame, time_col: str, tie_cols: list[str], test_size: float = TEST_SIZE,
               val_size: float = VAL_SIZE) -> DataFrame:
    """Sorted by time (nulls first): train before int(n (1 - test - val)),
    validation before int(n (1 - test)), test after. Rows of one time that a cut
    parts are numbered by ``tie_cols``."""
    kind = df.schema[time_col].dataType.typeName()

    def sizes(n: int) -> tuple[int, int]:
        first = int(n * (1 - test_size - val_size))
        return first, int(n * (1 - test_size)) - first

    names = ["train", "validation", "test"]
    if kind in ("date", "timestamp", "timestamp_ntz", "byte", "short", "integer", "long"):
        t = q(time_col).cast("long") if kind in ("byte", "short", "integer", "long") else F.unix_micros(q(time_col).cast("timestamp"))
        return _cut(df, F.coalesce(t, F.lit(-(1 << 63))), sizes, names, [time_col, *tie_cols])
    # times of another type have no order as numbers: their distinct values are ranked
    codes = with_row_index(df.select(q(time_col).alias("_v")).distinct(), ["_v"], "_code")
    coded = df.join(codes, q(time_col).eqNullSafe(F.col("_v")))
    return _cut(coded, F.col("_code"), sizes, names, [time_col, *tie_cols]).drop("_v", "_code")


# ---------------------------------------------------------------- SPL-4
def target_distribution(split_df: DataFrame, target: str) -> DataFrame:
    c = split_df.groupBy("split", q(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


# ---------------------------------------------------------------- ENC
@dataclass
class EncoderParams:
    """Fitted encoders and scaler; frames stay distributed."""
    methods: dict = field(default_factory=dict)        # col -> (method, cardinality, reason)
    ohe_values: dict = field(default_factory=dict)     # col -> sorted values (<= 50)
    target_stats: dict = field(default_factory=dict)   # col -> DataFrame(value, enc) ; prior
    ordinal_maps: dict = field(default_factory=dict)   # col -> DataFrame(value, code)
    scaler: str = "standard"
    scale_stats: dict = field(default_factory=dict)    # col -> (center, scale)


def choose_encoding(cardinality: int, rows: int, has_target: bool) -> tuple[str, str]:
    if cardinality <= OHE_MAX:
        return "OHE", f"Low cardinality ({cardinality}<=50)"
    if rows > TARGET_MIN_ROWS and has_target:
        return "Target_KFold", f"High cardinality ({cardinality}>50) and n={rows:,}"
    return "Ordinal", "Fallback encoding"


def fit_target_encoder(train: DataFrame, col: str, target: str, smoothing: float = TE_SMOOTHING,
                       min_leaf: int = TE_MIN_LEAF) -> tuple[DataFrame, float]:
    """prior (1 - w) + mean w with w = 1 / (1 + exp(-(n - min_leaf) / smoothing));
    a category seen once gets the prior."""
    y = q(target).cast("double")
    prior = train.agg(F.avg(y)).first()[0]
    st = train.filter(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"))
    w = 1 / (1 + F.exp(-(F.col("n") - min_leaf) / smoothing))
    enc = F.when(F.col("n") == 1, F.lit(prior)).otherwise(F.lit(prior) * (1 - w) + F.col("m") * w)
    return st.select("value", enc.alias("enc")), prior


def fit_ordinal(train: DataFrame, col: str, order_cols: list[str]) -> DataFrame:
    """Code = order of first appearance (by ``order_cols``), from 0."""
    first = train.filter(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value")).agg(
        F.min(F.struct(*[q(c) for c in order_cols])).alias("_first"))
    return with_row_index(first.select("value", F.col("_first").alias("_first")), ["_first"], "code") \
        .select("value", "code")


def fit_encoders(train: DataFrame, target: str | None = None, domain: str = "logistics",
                 order_cols: list[str] | None = None, cat_cols: list[str] | None = None) -> EncoderParams:
    p = EncoderParams()
    cats = [c for c in (cat_cols if cat_cols is not None else categorical_columns(train)) if c != target]
    st = train.agg(F.count(F.lit(1)).alias("_n"), *[F.count_distinct(q(c)).alias(f"d{i}") for i, c in enumerate(cats)]).first()
    n = st["_n"]
    for i, c in enumerate(cats):
        card = st[f"d{i}"]
        m, why = choose_encoding(card, n, bool(target))
        p.methods[c] = (m, card, why)
        if m == "OHE":
            p.ohe_values[c] = sorted(r[0] for r in train.select(q(c).cast("string")).distinct().collect()
                                     if r[0] is not None)  # at most 50 values
        elif m == "Target_KFold":
            p.target_stats[c] = fit_target_encoder(train, c, target)
        else:
            p.ordinal_maps[c] = fit_ordinal(train, c, order_cols or [c])
    return p


def fit_scaler(train: DataFrame, cols: list[str], method: str = "standard", exact: bool = True) -> dict:
    """standard: (mean, population std; 1 when 0); robust: (median, IQR; 1 when 0)."""
    if not cols:
        return {}
    if method == "robust":
        qs = exact_quantiles(train, cols, [0.25, 0.5, 0.75])
        out = {}
        for c in cols:
            p = qs[c]
            iqr = (p[2] - p[0]) if p[0] is not None else None
            out[c] = (p[1], iqr if iqr else 1.0)
        return out
    row = train.agg(*[F.avg(q(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(q(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)}


def transform(df: DataFrame, p: EncoderParams, scale: bool = True) -> DataFrame:
    """Apply fitted encoders, then the scaler (to numeric and encoded
    columns; dummies are boolean and not scaled)."""
    out = df
    for c, (m, _, _) in p.methods.items():
        if c not in out.columns:
            continue
        if m == "OHE":
            vals = p.ohe_values[c]
            s = q(c).cast("string")
            dummies = [F.coalesce(s == F.lit(v), F.lit(False)).alias(f"{c}_{v}") for v in vals]
            out = out.select(*[q(x) for x in out.columns if x != c], *dummies)
        elif m == "Target_KFold":
            stats, prior = p.target_stats[c]
            st = stats.select(F.col("value").alias("_v"), F.col("enc").alias("_enc"))
            out = (out.join(st, q(c).cast("string") == F.col("_v"), "left")
                      .withColumn(c, F.coalesce(F.col("_enc"), F.lit(prior))).drop("_v", "_enc"))
        else:
            mp = p.ordinal_maps[c].select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            out = (out.join(mp, q(c).cast("string") == F.col("_v"), "left")
                      .withColumn(c, F.col("_code").cast("double")).drop("_v", "_code"))
    if scale and p.scale_stats:
        out = out.select(*[((q(c).cast("double") - F.lit(p.scale_stats[c][0])) / F.lit(p.scale_stats[c][1])).alias(c)
                           if c in p.scale_stats else q(c) for c in out.columns])
    return out


def fit(train: DataFrame, target: str | None = None, domain: str = "logistics",
        order_cols: list[str] | None = None, cat_cols: list[str] | None = None,
        exclude: list[str] | None = None) -> EncoderParams:
    """Fit encoders on train, then the scaler on the encoded train (numeric
    and target-/ordinal-encoded columns; the target and ``exclude`` left out)."""
    p = fit_encoders(train, target, domain, order_cols, cat_cols)
    enc = transform(train, p, scale=False)
    skip = set([target] if target else []) | set(exclude or [])
    nums = [f.name for f in enc.schema.fields if is_numeric(f.dataType) and f.name not in skip]
    p.scaler = "robust" if domain == "finance" else "standard"
    p.scale_stats = fit_scaler(enc, nums, p.scaler)
    return p


def encoding_report(p: EncoderParams, spark) -> DataFrame:
    rows = [(c, m, int(card), why) for c, (m, card, why) in p.methods.items()]
    return spark.createDataFrame(rows, "column string, method string, cardinality long, reason string")
