"""QC-1 .. QC-9."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions.util import with_row
from tessera.operators import quality as qc
from tessera.plans.catalog.fixtures import EVENTS_NULLS_SQL, events_nulls, per_column_union
from tessera.plans.registry import load, query

EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("qc_missing", f"""
WITH {EVENTS_NULLS_SQL}
""" + per_column_union(EV_COLS, """SELECT {i} AS position, '{c}' AS "column",
  round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 4) AS missing_pct,
  CASE WHEN avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 THEN 'WARN' ELSE 'PASS' END AS status
FROM ev"""))
def qc_missing(spark, sf):
    return qc.missing_scan(events_nulls(spark, sf))


@query("qc_duplicates", """
WITH t AS (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem),
ne AS (SELECT * FROM t WHERE NOT (l_returnflag IS NULL AND l_linestatus IS NULL AND l_quantity IS NULL))
SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM ne) AS empty_rows_removed,
       (SELECT count(*) FROM ne) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ne)) AS duplicate_rows_removed,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM ne)) AS rows_after
""")
def qc_duplicates(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return qc.fix_counts(li)


@query("qc_dedup_rows", """
SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem
""")
def qc_dedup_rows(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    clean, _ = qc.auto_fix(li)
    return clean


_KEY_SQL = """SELECT '{c}' AS key,
  count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS duplicates,
  round((count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END) / count(*), 4) AS duplicates_pct,
  count(*) - count({c}) AS nulls,
  round((count(*) - count({c})) / count(*), 4) AS nulls_pct,
  CASE WHEN (count(*) - count(DISTINCT {c}) - CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END) / count(*) > 0.1
         OR (count(*) - count({c})) / count(*) > 0.1 THEN 'STOP' ELSE 'PASS' END AS status
FROM ev"""


@query("qc_key_check", f"""
WITH {EVENTS_NULLS_SQL}
""" + per_column_union(["event_id", "user_id"], _KEY_SQL) + """
UNION ALL SELECT 'shipment_id', NULL, NULL, NULL, NULL, 'STOP'
""")
def qc_key_check(spark, sf):
    return qc.key_check(events_nulls(spark, sf), ["event_id", "user_id", "shipment_id"])


@query("qc_future_dates", """
SELECT 'l_shipdate' AS "column", count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01') AS future_dates,
       round(count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01') / count(*), 4) AS future_pct
FROM lineitem
""")
def qc_future_dates(spark, sf):
    return qc.future_dates(load(spark, sf, "lineitem"), dt.datetime(2000, 1, 1))


_INV_SQL = """SELECT {i} AS position, '{c}' AS "column", count(*) FILTER (WHERE v < pv) AS inversions,
  count(*) AS non_null, round(coalesce(count(*) FILTER (WHERE v < pv) / count(*), 0), 4) AS inversion_pct,
  CASE WHEN count(*) FILTER (WHERE v < pv) / count(*) > 0.005 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT {c} AS v, lag({c}) OVER (ORDER BY event_id) AS pv FROM ev WHERE {c} IS NOT NULL)"""


@query("qc_date_inversions", f"""
WITH {EVENTS_NULLS_SQL}
""" + per_column_union(["ts", "value", "user_id"], _INV_SQL))
def qc_date_inversions(spark, sf):
    return qc.date_inversions(events_nulls(spark, sf), ["event_id"], ["ts", "value", "user_id"])


@query("qc_date_inversions_lineitem", """
SELECT 0 AS position, 'l_shipdate' AS "column", count(*) FILTER (WHERE v < pv) AS inversions,
  count(*) AS non_null, round(count(*) FILTER (WHERE v < pv) / count(*), 4) AS inversion_pct,
  CASE WHEN count(*) FILTER (WHERE v < pv) / count(*) > 0.005 THEN 'WARN' ELSE 'PASS' END AS status
FROM (SELECT l_shipdate AS v, lag(l_shipdate) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pv FROM lineitem)
""")
def qc_date_inversions_lineitem(spark, sf):
    li = load(spark, sf, "lineitem")
    return qc.date_inversions(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


@query("qc_status", f"""
WITH {EVENTS_NULLS_SQL},
miss AS (SELECT max(CASE WHEN m > 0.2 THEN 1 ELSE 0 END) AS w FROM (
  SELECT avg(CASE WHEN user_id IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM ev
  UNION ALL SELECT avg(CASE WHEN event_type IS NULL THEN 1.0 ELSE 0.0 END) FROM ev
  UNION ALL SELECT avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM ev)),
keys AS (SELECT CASE WHEN (count(*) - count(DISTINCT event_id)) / count(*) > 0.1
                       OR (count(*) - count(event_id)) / count(*) > 0.1 THEN 1 ELSE 0 END AS s FROM ev)
SELECT CASE WHEN (SELECT s FROM keys) = 1 THEN 'STOP' WHEN (SELECT w FROM miss) = 1 THEN 'WARN'
            ELSE 'PASS' END AS status
""")
def qc_status(spark, sf):
    ev = events_nulls(spark, sf)
    return qc.overall_status(qc.missing_scan(ev), qc.key_check(ev, ["event_id"]))


@query("qc_report_status", """
WITH inv AS (SELECT count(*) FILTER (WHERE v < pv) / count(*) AS p
             FROM (SELECT o_orderdate AS v, lag(o_orderdate) OVER (ORDER BY o_orderkey) AS pv FROM orders)),
k AS (SELECT (count(*) - count(DISTINCT o_orderkey)) / count(*) AS d1,
             (count(*) - count(DISTINCT o_custkey)) / count(*) AS d2 FROM orders)
SELECT CASE WHEN (SELECT greatest(d1, d2) FROM k) > 0.1 THEN 'STOP'
            WHEN (SELECT p FROM inv) > 0.005 THEN 'WARN' ELSE 'PASS' END AS status,
       2 AS n_keys
""")
def qc_report_status(spark, sf):
    """Full gate on orders with a missing key: STOP (report only)."""
    out = qc.run_quality_control(load(spark, sf, "orders"), keys=["o_orderkey", "o_custkey"],
                                 order_cols=["o_orderkey"], as_of=dt.datetime(2000, 1, 1))
    return with_row(out["status"], out["keys"].groupBy().agg(F.count(F.lit(1)).alias("n_keys")))
