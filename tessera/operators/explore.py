"""Exploration (ML-1 .. ML-4): feature matrix, k-means with silhouette,
PCA to 90 % variance, isolation-forest anomaly flags.

* The scaled feature vector is one ``select`` (moments from one aggregate).
* k-means advances all k and starts in shared scans (``operators.kmeans``); PCA
  is Spark ML's distributed Gram matrix.
* Isolation forest: a tree needs only min(256, n) rows by definition, so
  every tree draws its rows from the whole table by a seeded hash of its own;
  the trees are grown on the driver (256 rows x trees), broadcast, and every row
  is scored in a vectorised pandas UDF. The 5 % threshold is a quantile of
  the scores computed by a bounded-memory aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.columns import numeric_columns, q
from tessera.functions.util import spread
from tessera.operators import kmeans

SEED = 42


# ------------------------------------------------------------------ ML-1
def feature_matrix(df: DataFrame, cols: list[str] | None = None, keep: list[str] | None = None,
                   out_col: str = "features") -> DataFrame:
    """Numeric columns, null -> 0, standard-scaled with the population std
    (constant column -> 0), assembled into one vector column."""
    cols = cols if cols is not None else numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("need at least two numeric columns")
    x = {c: F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in cols}
    st = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    scaled = [((x[c] - F.lit(st[f"m{i}"])) / F.lit(st[f"s{i}"] or 1.0)) for i, c in enumerate(cols)]
    return df.select(*[q(k) for k in (keep or [])], array_to_vector(F.array(*scaled)).alias(out_col))


def vector_matrix(df: DataFrame, array_col: str, keep: list[str] | None = None, out_col: str = "features",
                  scale: bool = True) -> DataFrame:
    """An array<float> column as a (standard-scaled) vector column."""
    arr = F.col(array_col).cast("array<double>")
    n = df.select(F.max(F.size(arr))).first()[0]
    cols = [arr[i].alias(f"_e{i}") for i in range(n)]
    wide = df.select(*[q(k) for k in (keep or [])], *cols)
    if not scale:
        return wide.select(*[q(k) for k in (keep or [])],
                           array_to_vector(F.array(*[F.col(f"_e{i}") for i in range(n)])).alias(out_col))
    return feature_matrix(wide, [f"_e{i}" for i in range(n)], keep, out_col)


# ------------------------------------------------------------------ ML-2
def kmeans_best_k(features: DataFrame, k_max: int = 10, seed: int = SEED, max_iter: int = 300,
                  n_init: int = 10) -> tuple[DataFrame, DataFrame]:
    """k from 2 to min(11, n // 10) - 1; best silhouette (Spark's squared
    Euclidean form). ``n_init`` k-means|| starts per k, the lowest cost kept; all
    starts of all k share their scans. Returns (scores per k, cluster sizes of
    the best k)."""
    spark = features.sparkSession
    ks = list(range(2, min(k_max + 1, features.count() // 10)))
    models = kmeans.fit_many(features, ks, n_init, seed, max_iter) if ks else []
    best = max(models, key=lambda m: m.silhouette, default=None)
    sizes = [(i, int(n)) for i, n in enumerate(best.sizes)] if best else []
    return (spark.createDataFrame([(m.k, m.silhouette) for m in models], "k int, silhouette double"),
            spark.createDataFrame(sizes, "cluster int, size long"))


# ------------------------------------------------------------------ ML-3
def pca_variance(features: DataFrame, n_features: int, share: float = 0.90) -> DataFrame:
    """Explained-variance shares and running sums up to the first component
    reaching ``share`` of the variance (4 dp); one Gram-matrix pass."""
    model = PCA(k=n_features, inputCol="features", outputCol="_pca").fit(features.select("features"))
    ev = [float(v) for v in model.explainedVariance.toArray()]
    rows, cum = [], 0.0
    for i, v in enumerate(ev):
        cum += v
        rows.append((i + 1, v, cum))
        if cum >= share - 1e-12:
            break
    out = features.sparkSession.createDataFrame(rows, "component int, variance_ratio double, cumulative double")
    return out.select("component", F.round("variance_ratio", 4).alias("variance_ratio"),
                      F.round("cumulative", 4).alias("cumulative"))


# ------------------------------------------------------------------ ML-4
def _c(n: int) -> float:
    if n > 2:
        return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n
    return 1.0 if n == 2 else 0.0


def _grow(X: np.ndarray, rng: np.random.Generator, limit: int):
    """Array-encoded isolation tree: (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= limit or len(idx) <= 1:
            return i
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[i], thr[i] = f, t
        left[i] = node(idx[mask], depth + 1)
        right[i] = node(idx[~mask], depth + 1)
        return i

    node(np.arange(len(X)), 0)
    return (np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size))


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    """Path length of every row of X, all rows at once, level by level."""
    feat, thr, left, right, size = tree
    node = np.zeros(len(X), dtype=np.int64)
    depth = np.zeros(len(X))
    rows = np.arange(len(X))
    while True:
        f = feat[node]
        active = f >= 0
        if not active.any():
            break
        go_left = X[rows[active], f[active]] < thr[node[active]]
        node[active] = np.where(go_left, left[node[active]], right[node[active]])
        depth[active] += 1
    return depth + np.array([_c(int(v)) for v in size])[node]


def fit_isolation_forest(features: DataFrame, key_cols: list[str], n_trees: int = 100, max_samples: int = 256,
                         seed: int = SEED):
    """Grow each tree from the ``max_samples`` rows of the whole table that rank
    first by the tree's own hash of the key. One pass: a row is sent on for the
    trees in whose first ``4 x max_samples`` rows it is to be expected, and the
    ranks are taken among those (fewer than ``max_samples`` of them: chance
    below 1e-100, so no tree is short)."""
    n = features.count()
    psi = min(max_samples, n)
    top = (1 << 63) - 1
    reach = top if n <= 4 * psi else int(top * (4 * psi / n))
    key = F.xxhash64(*[q(k) for k in key_cols])
    draws = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                        lambda t: F.struct(t.alias("tree"), F.xxhash64(key, t + seed).bitwiseAND(top).alias("h")))
    w = Window.partitionBy("d.tree").orderBy("d.h", "x")
    rows = (features.select(vector_to_array("features").alias("x"), F.explode(F.filter(draws, lambda d: d["h"] <= reach)).alias("d"))
            .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= psi)
            .select("d.tree", "r", "x").collect())  # psi rows a tree
    rng = np.random.default_rng(seed)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    drawn: list[list] = [[] for _ in range(n_trees)]
    for r in sorted(rows, key=lambda r: (r.tree, r.r)):
        drawn[r.tree].append(r.x)
    return [_grow(np.array(x, dtype=float), rng, limit) for x in drawn], psi


def isolation_scores(features: DataFrame, trees, psi: int, keep: list[str]) -> DataFrame:
    spark = features.sparkSession
    bc = spark.sparkContext.broadcast(trees)
    cn = _c(psi)

    @F.pandas_udf(T.DoubleType())
    def score(v: pd.Series) -> pd.Series:
        X = np.vstack(v.to_numpy()) if len(v) else np.zeros((0, 1))
        depth = np.mean([_path_lengths(X, t) for t in bc.value], axis=0) if len(v) else np.zeros(0)
        return pd.Series(np.power(2.0, -depth / cn))

    return spread(features).select(*[q(k) for k in keep], score(vector_to_array("features")).alias("anomaly_score"))


def isolation_forest(features: DataFrame, key_cols: list[str], contamination: float = 0.05,
                     n_trees: int = 100, seed: int = SEED) -> DataFrame:
    """Rows flagged when their score is above the (1 - contamination)
    quantile of all scores (bounded-memory quantile, relative rank error
    1e-5). Adds anomaly_score and anomaly_flag."""
    trees, psi = fit_isolation_forest(features, key_cols, n_trees, seed=seed)
    # the scores are read twice (threshold, then flags): keep the narrow
    # (key, score) frame; a lost block is recomputed from its lineage
    scored = isolation_scores(features, trees, psi, key_cols).persist()
    cut = scored.agg(F.percentile_approx("anomaly_score", F.lit(1 - contamination), F.lit(100000))).first()[0]
    return scored.withColumn("anomaly_flag", F.col("anomaly_score") > F.lit(cut))
