"""FEA-1..12, KPI-1..7, SIG-1..7, REC-1..2, MON-1."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import features as fea
from tessera.operators import kpi, signals
from tessera.plans.catalog.fixtures import (ACCOUNTS_SQL, CAMPAIGNS_SQL, EVENTS_NULLS_SQL, PATIENTS_SQL,
                                            RETAIL_SQL, SHIP_SQL, SHIPF_SQL, accounts, campaigns, events_nulls,
                                            patients, retail_orders, shipments, shipments_features)
from tessera.plans.registry import load, query

AS_OF = dt.datetime(2003, 1, 1)


# ------------------------------------------------------------------ features
@query("transit_features", f"""
WITH {SHIPF_SQL}
SELECT order_id, line_no, l_partkey, carrier, round(transit_time, 4) AS transit_time, sla_flag, rto_flag
FROM shipf
""")
def transit_features(spark, sf):
    out = shipments_features(spark, sf)
    return round_doubles(out.select("order_id", "line_no", "l_partkey", "carrier", "transit_time",
                                    "sla_flag", "rto_flag"), 4)


@query("cap_outliers", f"""
WITH {SHIPF_SQL}
SELECT 'transit_time' AS "column", 240.0 AS cap_value, count(*) FILTER (WHERE th > 240) AS n_capped FROM shipf
""")
def cap_outliers(spark, sf):
    _, _, caps = fea.feature_draft(shipments(spark, sf), "logistics")
    return caps


@query("feature_specs", f"""
WITH {SHIPF_SQL}
SELECT * FROM (VALUES
  ('transit_time', 'Hours between pickup and delivery', 'double', '(delivery_date - pickup_date) in hours'),
  ('sla_flag', '1 if delivered within 48h SLA', 'int', 'transit_time <= 48'),
  ('rto_flag', '1 if shipment returned to origin', 'int', 'status contains ''return''')
) AS v(name, description, dtype, derivation),
LATERAL (SELECT (v.name = 'transit_time' AND (SELECT count(*) FROM shipf WHERE th > 240) > 0) AS capped,
                CASE WHEN v.name = 'transit_time' THEN 240.0 END AS cap_value)
""")
def feature_specs(spark, sf):
    _, specs, _ = fea.feature_draft(shipments(spark, sf), "logistics")
    return specs


@query("los_features", f"""
WITH {PATIENTS_SQL}
SELECT patient_id, stay_no, ward,
       round(least((epoch_us(discharge_ts) - epoch_us(admission_ts)) / 8.64e10, 365), 4) AS los_days,
       CASE WHEN age > 0 AND age <= 18 THEN 'Child' WHEN age > 18 AND age <= 40 THEN 'Adult'
            WHEN age > 40 AND age <= 60 THEN 'Middle' WHEN age > 60 AND age <= 100 THEN 'Senior' END AS age_group
FROM pat
""")
def los_features(spark, sf):
    out, _, _ = fea.feature_draft(patients(spark, sf), "healthcare")
    return round_doubles(out.select("patient_id", "stay_no", "ward", "los_days", "age_group"), 4)


@query("age_groups", f"""
WITH {PATIENTS_SQL}
SELECT CASE WHEN age > 0 AND age <= 18 THEN 'Child' WHEN age > 18 AND age <= 40 THEN 'Adult'
            WHEN age > 40 AND age <= 60 THEN 'Middle' WHEN age > 60 AND age <= 100 THEN 'Senior' END AS age_group,
       count(*) AS n
FROM pat GROUP BY 1
""")
def age_groups(spark, sf):
    out, _, _ = fea.feature_draft(patients(spark, sf), "healthcare")
    return out.groupBy("age_group").agg(F.count(F.lit(1)).alias("n"))


@query("order_value", f"""
WITH {RETAIL_SQL}
SELECT order_id, line_no, product_id, round(quantity * price, 4) AS order_value,
       CASE WHEN contains(lower(status), 'return') THEN 1 ELSE 0 END AS return_flag
FROM ret
""")
def order_value(spark, sf):
    out, _, _ = fea.feature_draft(retail_orders(spark, sf), "retail")
    return round_doubles(out.select("order_id", "line_no", "product_id", "order_value", "return_flag"), 4)


@query("ctr", f"""
WITH {CAMPAIGNS_SQL}
SELECT campaign_id, round(clicks / nullif(impressions, 0), 6) AS ctr,
       CASE WHEN conversions > 0 THEN 1 ELSE 0 END AS conversion_flag
FROM camp
""")
def ctr(spark, sf):
    out, _, _ = fea.feature_draft(campaigns(spark, sf), "emarketing")
    return round_doubles(out.select("campaign_id", "ctr", "conversion_flag"), 6)


@query("loan_duration", f"""
WITH {ACCOUNTS_SQL}
SELECT account_id, floor((epoch_us(TIMESTAMP '2003-01-01') - epoch_us(open_date)) / 8.64e10) AS loan_duration_days,
       default_flag AS overdue_flag
FROM acc
""")
def loan_duration(spark, sf):
    out, _, _ = fea.feature_draft(accounts(spark, sf), "finance", as_of=AS_OF)
    return out.select("account_id", "loan_duration_days", "overdue_flag")


# ------------------------------------------------------------------ KPI-1
@query("kpi_logistics", f"""
WITH {SHIPF_SQL}
SELECT round(avg(sla_flag) * 100, 4) AS sla_pct, round(avg(rto_flag) * 100, 4) AS rto_pct,
       NULL::DOUBLE AS fas_pct, round(avg(transit_time), 4) AS avg_transit_h, count(*) AS total_shipments
FROM shipf
""")
def kpi_logistics(spark, sf):
    return round_doubles(kpi.compute_kpis(shipments_features(spark, sf), "logistics"), 4)


@query("kpi_retail", f"""
WITH {RETAIL_SQL}
SELECT round(sum(quantity * price), 2) AS gmv, round(avg(quantity * price), 4) AS aov,
       round(avg(CASE WHEN contains(lower(status), 'return') THEN 1 ELSE 0 END) * 100, 4) AS return_pct,
       NULL::DOUBLE AS basket_size, count(*) AS total_orders
FROM ret
""")
def kpi_retail(spark, sf):
    out, _, _ = fea.feature_draft(retail_orders(spark, sf), "retail")
    k = kpi.compute_kpis(out, "retail")
    return round_doubles(k.withColumn("gmv", F.round("gmv", 2)), 4)


@query("kpi_finance", f"""
WITH {ACCOUNTS_SQL}
SELECT round(avg(default_flag) * 100, 4) AS npl_pct, round(avg(balance), 4) AS avg_balance,
       NULL::DOUBLE AS liquidity_ratio, count(*) AS total_accounts
FROM acc
""")
def kpi_finance(spark, sf):
    return round_doubles(kpi.compute_kpis(accounts(spark, sf), "finance"), 4)


@query("kpi_healthcare", f"""
WITH {PATIENTS_SQL}
SELECT round(avg(least((epoch_us(discharge_ts) - epoch_us(admission_ts)) / 8.64e10, 365)), 4) AS avg_los_days,
       round(avg(readmission_flag) * 100, 4) AS readmission_30d_pct, NULL::DOUBLE AS bed_occupancy_pct,
       count(*) AS total_admissions
FROM pat
""")
def kpi_healthcare(spark, sf):
    out, _, _ = fea.feature_draft(patients(spark, sf), "healthcare")
    return round_doubles(kpi.compute_kpis(out, "healthcare"), 4)


@query("kpi_emarketing", f"""
WITH {CAMPAIGNS_SQL}
SELECT round(avg(clicks / nullif(impressions, 0)) * 100, 4) AS ctr_pct,
       round(avg(CASE WHEN conversions > 0 THEN 1 ELSE 0 END) * 100, 4) AS conversion_pct,
       NULL::DOUBLE AS cac, NULL::DOUBLE AS roas, count(*) AS total_campaigns
FROM camp
""")
def kpi_emarketing(spark, sf):
    out, _, _ = fea.feature_draft(campaigns(spark, sf), "emarketing")
    return round_doubles(kpi.compute_kpis(out, "emarketing"), 4)


# ------------------------------------------------------------- KPI-3..6
FORMULAS = {
    "delivered_pct": {"type": "ratio", "multiplier": 100,
                      "numerator": {"aggregation": "count", "filter": {"column": "event_type", "operator": "equals",
                                                                       "value": "Delivered"}},
                      "denominator": {"aggregation": "count"}},
    "not_click_pct": {"type": "ratio", "multiplier": 100,
                      "numerator": {"aggregation": "count", "filter": {"column": "event_type",
                                                                       "operator": "not_equals", "value": "click"}},
                      "denominator": {"aggregation": "count"}},
    "not_in_share": {"type": "ratio",
                     "numerator": {"aggregation": "count", "filter": {"column": "event_type", "operator": "not_in",
                                                                      "values": ["view", "signup"]}},
                     "denominator": {"aggregation": "count", "column": "event_id"}},
    "mean_big_value": {"type": "average", "aggregation": {"aggregation": "mean", "column": "value",
                                                          "filter": {"operator": "gt", "value": 50}}},
    "median_value": {"type": "median", "format": "currency",
                     "aggregation": {"aggregation": "median", "column": "Value"}},
    "sum_mid_value": {"type": "sum", "aggregation": {"aggregation": "sum", "column": "value",
                                                     "filter": {"operator": "between", "values": [10, 20]}}},
    "users": {"type": "count", "aggregation": {"aggregation": "nunique", "column": "user_id"}},
    "typed_rows": {"type": "count", "aggregation": {"aggregation": "count", "column": "value",
                                                    "filter": {"column": "event_type", "operator": "exists"}}},
    "untyped_rows": {"type": "count", "aggregation": {"aggregation": "count",
                                                      "filter": {"column": "event_type", "operator": "not_exists"}}},
    "zero_ratio": {"type": "ratio", "numerator": {"aggregation": "count"},
                   "denominator": {"aggregation": "count", "filter": {"column": "event_type", "operator": "equals",
                                                                      "value": "none"}}},
    "skip_ratio": {"type": "ratio", "guard_rail": "skip_on_zero", "numerator": {"aggregation": "count"},
                   "denominator": {"aggregation": "count", "filter": {"column": "event_type", "operator": "in",
                                                                      "values": ["none"]}}},
    "low_value_share": {"type": "ratio", "multiplier": 100,
                        "numerator": {"aggregation": "count", "column": "value",
                                      "filter": {"operator": "lte", "value": 5}},
                        "denominator": {"aggregation": "count", "column": "value",
                                        "filter": {"operator": "gte", "value": 0}}},
    "bad_column": {"type": "average", "aggregation": {"aggregation": "mean", "column": "no_such_column"}},
}


@query("kpi_formulas", f"""
WITH {EVENTS_NULLS_SQL},
a AS (SELECT
  count(*) FILTER (WHERE event_type = 'Delivered') AS n0, count(*) AS d0,
  count(*) FILTER (WHERE event_type IS DISTINCT FROM 'click') AS n1,
  count(*) FILTER (WHERE event_type IS NULL OR event_type NOT IN ('view', 'signup')) AS n2, count(event_id) AS d2,
  avg(value) FILTER (WHERE value > 50) AS n3, median(value) AS n4,
  coalesce(sum(value) FILTER (WHERE value BETWEEN 10 AND 20), 0) AS n5,
  count(DISTINCT user_id) AS n6, count(value) FILTER (WHERE event_type IS NOT NULL) AS n7,
  count(*) FILTER (WHERE event_type IS NULL) AS n8,
  count(*) FILTER (WHERE event_type = 'none') AS d9,
  count(value) FILTER (WHERE value <= 5) AS n11, count(value) FILTER (WHERE value >= 0) AS d11
  FROM ev),
v AS (
  SELECT 0 AS position, 'delivered_pct' AS kpi, CASE WHEN d0 = 0 THEN 0.0 ELSE n0 / d0 * 100 END AS value, 'percentage' AS fmt, true AS r FROM a
  UNION ALL SELECT 1, 'not_click_pct', CASE WHEN d0 = 0 THEN 0.0 ELSE n1 / d0 * 100 END, 'percentage', true FROM a
  UNION ALL SELECT 2, 'not_in_share', CASE WHEN d2 = 0 THEN 0.0 ELSE n2 / d2 END, 'percentage', true FROM a
  UNION ALL SELECT 3, 'mean_big_value', n3, 'number', false FROM a
  UNION ALL SELECT 4, 'median_value', n4, 'currency', false FROM a
  UNION ALL SELECT 5, 'sum_mid_value', n5, 'number', false FROM a
  UNION ALL SELECT 6, 'users', n6, 'number', false FROM a
  UNION ALL SELECT 7, 'typed_rows', n7, 'number', false FROM a
  UNION ALL SELECT 8, 'untyped_rows', n8, 'number', false FROM a
  UNION ALL SELECT 9, 'zero_ratio', CASE WHEN d9 = 0 THEN 0.0 ELSE d0 / d9 END, 'percentage', true FROM a
  UNION ALL SELECT 10, 'skip_ratio', CASE WHEN d9 = 0 THEN NULL ELSE d0 / d9 END, 'percentage', true FROM a
  UNION ALL SELECT 11, 'low_value_share', CASE WHEN d11 = 0 THEN 0.0 ELSE n11 / d11 * 100 END, 'percentage', true FROM a)
SELECT position, kpi, round(value, 4) AS value,
  CASE WHEN value IS NULL THEN 'fail' WHEN r AND value = 0 THEN 'warn' ELSE 'pass' END AS status,
  CASE WHEN value IS NULL THEN NULL WHEN fmt = 'percentage' THEN printf('%,.2f', value) || '%'
       WHEN fmt = 'currency' THEN '$' || printf('%,.2f', value) ELSE printf('%,.2f', value) END AS formatted,
  CASE WHEN value IS NULL THEN 'value could not be computed' WHEN r AND value = 0 THEN 'ratio evaluated to zero' END AS reason
FROM v
UNION ALL SELECT 12, 'bad_column', NULL, 'fail', NULL, 'Column ''no_such_column'' not found for aggregation.'
""")
def kpi_formulas(spark, sf):
    return round_doubles(kpi.evaluate_formulas(events_nulls(spark, sf), FORMULAS), 4)


@query("kpi_search", f"""
WITH {SHIP_SQL},
a AS (SELECT CAST(count(*) AS DOUBLE) AS n,
             count(*) FILTER (WHERE contains(lower(status), 'delivered')) * 100.0 / count(*) AS sla,
             avg((epoch_us(delivery_date) - epoch_us(pickup_date)) / 3.6e9) AS tr FROM ship)
SELECT 0 AS position, 'total_records' AS kpi, n AS value, NULL AS source_column, NULL AS reason FROM a
UNION ALL SELECT 1, 'total_columns', 9.0, NULL, NULL
UNION ALL SELECT 2, 'total_shipments', n, NULL, NULL FROM a
UNION ALL SELECT 3, 'sla_pct', round(sla, 4), 'status', NULL FROM a
UNION ALL SELECT 4, 'avg_transit_h', round(tr, 4), 'pickup_date->delivery_date', NULL FROM a
UNION ALL SELECT 5, 'rto_pct', NULL, NULL, 'no return column'
""")
def kpi_search(spark, sf):
    return round_doubles(kpi.search_kpis(shipments(spark, sf), "logistics"), 4)


# ------------------------------------------------------------------ SIG
SIG_COLS = ["quantity", "price", "transit_time"]


@query("signals_shape", f"""
WITH {SHIPF_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT 'shape' AS section, '{c}' AS \"column\", 'skew' AS metric, round(skewness({c}), 4) AS value FROM shipf "
    f"UNION ALL SELECT 'shape', '{c}', 'kurtosis', round(kurtosis({c}), 4) FROM shipf" for c in SIG_COLS))
def signals_shape(spark, sf):
    return round_doubles(signals.shape(shipments_features(spark, sf), SIG_COLS), 4)


@query("signals_outliers", f"""
WITH {SHIPF_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT 'outliers' AS section, '{c}' AS \"column\", 'outliers_pct_iqr' AS metric, "
    f"round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}), 4) "
    f"AS value FROM shipf, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM shipf)"
    for c in SIG_COLS))
def signals_outliers(spark, sf):
    return round_doubles(signals.outlier_pct_iqr(shipments_features(spark, sf), SIG_COLS), 4)


@query("signals_quantiles", f"""
WITH {SHIPF_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT 'quantiles' AS section, '{c}' AS \"column\", 'p{p}' AS metric, "
    f"round(quantile_cont({c}, {p / 100}), 4) AS value FROM shipf" for c in SIG_COLS for p in (90, 95)))
def signals_quantiles(spark, sf):
    return round_doubles(signals.tail_quantiles(shipments_features(spark, sf), SIG_COLS), 4)


@query("signals_trend", """
WITH d AS (SELECT date_trunc('day', ts) AS period, avg(value) AS y FROM events GROUP BY 1),
i AS (SELECT y, row_number() OVER (ORDER BY period) - 1 AS t FROM d),
s AS (SELECT regr_slope(y, t) AS slope, avg(y) AS ybar, count(*) AS m FROM i)
SELECT 'trends' AS section, 'value' AS "column", 'slope_norm_pct' AS metric,
       round(slope / CASE WHEN ybar = 0 THEN 1 ELSE ybar END * 100, 4) AS value FROM s WHERE m >= 5
UNION ALL SELECT 'trends', 'value', 'n_points', m FROM s WHERE m >= 5
""")
def signals_trend(spark, sf):
    return round_doubles(signals.trend_slope(load(spark, sf, "events"), "value", "D"), 4)


@query("signals_duplicates", f"""
WITH {SHIPF_SQL}
SELECT 'quality' AS section, 'order_id' AS "column", 'duplicates_pct' AS metric,
       round((count(*) - count(DISTINCT order_id)) * 100.0 / count(*), 4) AS value FROM shipf
""")
def signals_duplicates(spark, sf):
    return round_doubles(signals.duplicate_pct(shipments_features(spark, sf), ["order_id"]), 4)


_SHIPF_COLS = ["order_id", "line_no", "l_partkey", "carrier", "pickup_date", "delivery_date", "status", "quantity",
               "price", "transit_time", "sla_flag", "rto_flag"]
_SHIPF_NUM = ["order_id", "line_no", "l_partkey", "carrier", "quantity", "price", "transit_time", "sla_flag",
              "rto_flag"]


def _signals_all_sql():
    parts = ["SELECT 'meta' AS section, '' AS \"column\", 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM shipf",
             "SELECT 'kpis', '', 'sla_pct', avg(sla_flag) * 100 FROM shipf",
             "SELECT 'kpis', '', 'rto_pct', avg(rto_flag) * 100 FROM shipf",
             "SELECT 'kpis', '', 'fas_pct', NULL::DOUBLE",
             "SELECT 'kpis', '', 'avg_transit_h', avg(transit_time) FROM shipf",
             "SELECT 'kpis', '', 'total_shipments', CAST(count(*) AS DOUBLE) FROM shipf"]
    parts += [f"SELECT 'quality', '{c}', 'missing_pct', avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100 FROM shipf"
              for c in _SHIPF_COLS]
    parts.append("SELECT 'quality', 'order_id', 'duplicates_pct', (count(*) - count(DISTINCT order_id)) * 100.0 / count(*) "
                 "FROM shipf")
    for c in _SHIPF_NUM:
        parts += [f"SELECT 'shape', '{c}', 'skew', skewness({c}) FROM shipf",
                  f"SELECT 'shape', '{c}', 'kurtosis', kurtosis({c}) FROM shipf"]
    for c in _SHIPF_NUM:
        parts.append(f"SELECT 'outliers', '{c}', 'outliers_pct_iqr', count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) "
                     f"OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count({c}) FROM shipf, "
                     f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM shipf)")
    for c in _SHIPF_NUM:
        parts += [f"SELECT 'quantiles', '{c}', 'p90', quantile_cont({c}, 0.9) FROM shipf",
                  f"SELECT 'quantiles', '{c}', 'p95', quantile_cont({c}, 0.95) FROM shipf"]
    parts += ["SELECT 'trends', 'transit_time', 'slope_norm_pct', slope / CASE WHEN ybar = 0 THEN 1 ELSE ybar END * 100 "
              "FROM tr WHERE m >= 5",
              "SELECT 'trends', 'transit_time', 'n_points', CAST(m AS DOUBLE) FROM tr WHERE m >= 5"]
    body = "\nUNION ALL\n".join(parts)
    return (f"WITH {SHIPF_SQL},\n"
            "d AS (SELECT date_trunc('day', pickup_date) AS period, avg(transit_time) AS y FROM shipf GROUP BY 1),\n"
            "i AS (SELECT y, row_number() OVER (ORDER BY period) - 1 AS t FROM d),\n"
            "tr AS (SELECT regr_slope(y, t) AS slope, avg(y) AS ybar, count(*) AS m FROM i)\n"
            f"SELECT section, \"column\", metric, round(value, 4) AS value FROM ({body})")


@query("signals_all", _signals_all_sql())
def signals_all(spark, sf):
    return round_doubles(signals.build_signals(shipments_features(spark, sf), "logistics", ["order_id"]), 4)


@query("recommendations", f"""
WITH {SHIPF_SQL},
k AS (SELECT avg(sla_flag) * 100 AS sla, avg(rto_flag) * 100 AS rto FROM shipf),
d AS (SELECT date_trunc('day', pickup_date) AS period, avg(transit_time) AS y FROM shipf GROUP BY 1),
i AS (SELECT y, row_number() OVER (ORDER BY period) - 1 AS t FROM d),
s AS (SELECT CASE WHEN count(*) >= 5 THEN regr_slope(y, t) / CASE WHEN avg(y) = 0 THEN 1 ELSE avg(y) END END AS sl FROM i),
r AS (
  SELECT 0 AS rule, 'Carrier/HUB performance audit' AS title, 'high' AS severity FROM k, s
    WHERE coalesce(sla, 100) < 90 AND coalesce(sl, 0) > 0
  UNION ALL SELECT 1, 'Reduce RTO', 'medium' FROM k WHERE coalesce(rto, 0) > 5)
SELECT * FROM r ORDER BY rule LIMIT 3
""")
def recommendations(spark, sf):
    return signals.recommend(shipments_features(spark, sf), "logistics")


@query("quality_score", f"""
WITH {EVENTS_NULLS_SQL},
b AS (SELECT count(*) AS n,
        (count(*) - count(event_id) + count(*) - count(ts) + count(*) - count(user_id) + count(*) - count(event_type)
         + count(*) - count(value) + count(*) - count(props)) * 100.0 / (count(*) * 6) AS missing_rate FROM ev),
d AS (SELECT count(*) AS nd FROM (SELECT DISTINCT * FROM ev))
SELECT round((n - nd) * 100.0 / n, 4) AS duplicate_rate, round(missing_rate, 4) AS missing_rate,
       round(greatest(0, least(100, 100 - 0.5 * (n - nd) * 100.0 / n - 0.3 * missing_rate)), 4) AS quality_score
FROM b, d
""")
def quality_score(spark, sf):
    return round_doubles(signals.quality_score(events_nulls(spark, sf)), 4)


@query("drift_baseline", f"""
WITH {EVENTS_NULLS_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS baseline_mean, "
    f"round(stddev_samp({c}), 4) AS baseline_std, 0.1 AS psi_warn_threshold, 0.25 AS psi_action_threshold, "
    f"0.1 AS ks_warn_threshold, 0.2 AS ks_action_threshold FROM ev"
    for i, c in enumerate(["event_id", "user_id", "value"])))
def drift_baseline(spark, sf):
    return round_doubles(signals.drift_baseline(events_nulls(spark, sf)), 4)
