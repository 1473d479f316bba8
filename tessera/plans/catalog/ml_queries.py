"""ML-1 .. ML-4, SEL-1 .. SEL-5, IMP-9, IMP-10, PIPE-1 (where SQL has no
equivalent the properties are unit-tested)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.constants import DOMAIN_PACKS
from tessera.functions.util import round_doubles, with_row
from tessera.operators import explore, impute_models, select
from tessera.plans.catalog.fixtures import SHIP_SQL, events_nulls
from tessera.plans.registry import load, query

LI_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]
SHIP_COLS = ["order_id", "line_no", "l_partkey", "carrier", "pickup_date", "delivery_date", "status", "quantity", "price"]
LI_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _emb(spark, sf):
    return explore.vector_matrix(load(spark, sf, "embeddings"), "embedding", keep=["vec_id", "label"])


@query("kmeans_best_k")
def kmeans_best_k(spark, sf):
    scores, sizes = explore.kmeans_best_k(_emb(spark, sf))
    best = scores.orderBy(F.desc("silhouette")).limit(1).select(F.col("k").alias("best_k"))
    return round_doubles(with_row(scores, best), 4)


@query("kmeans_cluster_sizes")
def kmeans_cluster_sizes(spark, sf):
    _, sizes = explore.kmeans_best_k(_emb(spark, sf))
    return sizes


@query("pca_variance")
def pca_variance(spark, sf):
    return explore.pca_variance(_emb(spark, sf), 64)


def _fm_sql():
    cols = ", ".join(f"round((coalesce({c}, 0) - avg(coalesce({c}, 0)) OVER ()) / "
                     f"CASE WHEN stddev_pop(coalesce({c}, 0)) OVER () = 0 THEN 1 "
                     f"ELSE stddev_pop(coalesce({c}, 0)) OVER () END, 6)" for c in LI_FEATS)
    return f"SELECT {', '.join(LI_KEYS)}, [{cols}] AS features FROM lineitem"


@query("feature_matrix", _fm_sql())
def feature_matrix(spark, sf):
    li = load(spark, sf, "lineitem")
    fm = explore.feature_matrix(li, LI_FEATS, keep=LI_KEYS)
    from pyspark.ml.functions import vector_to_array
    return fm.select(*LI_KEYS, F.transform(vector_to_array("features"), lambda x: F.round(x, 6)).alias("features"))


@query("isolation_forest")
def isolation_forest(spark, sf):
    li = load(spark, sf, "lineitem")
    fm = explore.feature_matrix(li, LI_FEATS, keep=LI_KEYS)
    return round_doubles(explore.isolation_forest(fm, LI_KEYS), 6)


@query("anomaly_share")
def anomaly_share(spark, sf):
    li = load(spark, sf, "lineitem")
    fm = explore.feature_matrix(li, LI_FEATS, keep=LI_KEYS)
    flags = explore.isolation_forest(fm, LI_KEYS)
    return flags.agg(F.count_if("anomaly_flag").alias("n_anomalies"),
                     F.round(F.avg(F.col("anomaly_flag").cast("double")), 4).alias("anomaly_percentage"))


def _sel_frame(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(*LI_FEATS, (F.col("l_returnflag") == "R").cast("int").alias("returned"))


@query("feature_importance")
def feature_importance(spark, sf):
    imp = select.forest_importance(_sel_frame(spark, sf), LI_FEATS, "returned")
    return round_doubles(spark.createDataFrame(list(imp.items()), "feature string, importance double"), 6)


@query("feature_selection")
def feature_selection(spark, sf):
    table, passed = select.select_features(_sel_frame(spark, sf), "returned", LI_FEATS, top_k=4)
    return round_doubles(table.withColumn("vif_check_passed", F.lit(passed)), 6)


def _vif_sql(cols, table):
    """G_jj times the j-th diagonal of the inverse Gram matrix, by determinants."""
    def det(rows):
        if len(rows) == 1:
            return f"g{rows[0][0][0]}_{rows[0][0][1]}"
        return " ".join(f"{'-' if j % 2 else '+'} {'g%d_%d' % rows[0][j]} * ({det([r[:j] + r[j + 1:] for r in rows[1:]])})" for j in range(len(rows)))

    n = range(len(cols))
    cell = lambda i, j: (min(i, j), max(i, j))
    sums = ", ".join(f"sum({cols[i]} * {cols[j]}) AS g{i}_{j}" for i in n for j in n if i <= j)
    whole = det([[cell(i, j) for j in n] for i in n])
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(g{k}_{k} * ({det([[cell(i, j) for j in n if j != k] for i in n if i != k])}) / ({whole}), 6) AS vif FROM g" for k, c in enumerate(cols))
    return f"WITH g AS (SELECT {sums} FROM {table}) SELECT feature, vif, vif < 5 AS passed FROM ({rows})"


VIF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("vif", _vif_sql(VIF_COLS, "lineitem"))
def vif(spark, sf):
    return round_doubles(select.vif(load(spark, sf, "lineitem"), VIF_COLS), 6)


@query("impute_knn")
def impute_knn(spark, sf):
    ev = events_nulls(spark, sf).select("event_id", "user_id", "value")
    return round_doubles(impute_models.knn_impute(ev, ["event_id", "user_id", "value"]), 4)


@query("impute_mice")
def impute_mice(spark, sf):
    ev = events_nulls(spark, sf).select("event_id", "user_id", "value")
    return round_doubles(impute_models.chained_regression(ev, ["event_id", "user_id", "value"]), 4)


_EXPECTED = [c for c in DOMAIN_PACKS["logistics"]["expected_columns"] if c in SHIP_COLS]


# domain and imputation statuses and the rows come from the data; the statuses of the others are those of clean shipments
@query("staged_run", f"""
WITH {SHIP_SQL}, n AS (SELECT count(*) AS n, ({" + ".join(f"(count({c}) > 0)::INT" for c in _EXPECTED)}) / {len(DOMAIN_PACKS["logistics"]["expected_columns"])}.0 AS match,
  1 - ({" + ".join(f"count(*) - count({c})" for c in SHIP_COLS)}) / (count(*) * {len(SHIP_COLS)}.0) AS filled FROM ship)
SELECT s.step, s.stage, coalesce(s.status, CASE s.stage WHEN 'domain' THEN CASE WHEN match >= 0.7 THEN 'OK' WHEN match >= 0.3 THEN 'WARN' ELSE 'STOP' END
  WHEN 'ingest' THEN CASE WHEN n > 0 THEN 'OK' ELSE 'STOP' END ELSE CASE WHEN filled >= 0.8 THEN 'PASS' ELSE 'STOP' END END) AS status, n AS rows
FROM n, (VALUES (0, 'domain', NULL), (1, 'ingest', NULL), (2, 'quality', 'WARN'), (3, 'schema', 'OK'), (4, 'impute', NULL), (5, 'features', 'PASS')) AS s (step, stage, status)
""")
def staged_run(spark, sf):
    """Domain match -> landing -> quality gate -> typing -> imputation -> features on
    the shipments analogue; stops at the first STOP."""
    import datetime as dt

    from tessera.plans import stages as st
    from tessera.plans.catalog.fixtures import shipments
    from tessera.session import ensure_checkpoint_dir
    folder = f"{ensure_checkpoint_dir(spark)}/staged-{uuid.uuid4().hex}"
    res = st.run_stages(shipments(spark, sf), [
        ("domain", st.domain_stage("logistics")),
        ("ingest", st.ingest_stage(folder)),
        ("quality", st.quality_stage([], ["order_id", "line_no", "l_partkey", "carrier"],
                                     dt.datetime(2003, 1, 1))),
        ("schema", st.schema_stage()),
        ("impute", st.impute_stage()),
        ("features", st.feature_stage("logistics")),
    ], folder)
    return spark.createDataFrame([(i, r.name, r.status, r.rows) for i, r in enumerate(res)], "step int, stage string, status string, rows long")
