"""IMP-1 .. IMP-8, IMP-11 .. IMP-14."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import impute as imp
from tessera.plans.catalog.fixtures import EVENTS_NULLS_SQL, events_nulls
from tessera.plans.registry import load, query

_DEC = """SELECT {i} AS position, '{c}' AS "column", {method} AS method, {reason} AS reason,
  count(*) - count({c}) AS missing_before, (count(*) - count({c})) / count(*) AS missing_pct FROM ev
HAVING count(*) > count({c})"""


def _decisions_sql(group: bool):
    num = ("CASE WHEN (count(*) - count({c})) / count(*) <= 0.05 THEN 'median' "
           + ("WHEN (count(*) - count({c})) / count(*) <= 0.5 THEN 'group_median' " if group else "")
           + "WHEN count(*) < 2000 THEN " + ("'group_median'" if group else "'median'")
           + " WHEN count(*) < 10000 THEN " + ("'group_median'" if group else "'median'")
           + " ELSE 'knn' END")
    num_r = ("CASE WHEN (count(*) - count({c})) / count(*) <= 0.05 THEN 'low missing share' "
             + ("WHEN (count(*) - count({c})) / count(*) <= 0.5 THEN 'group structure present' " if group else "")
             + "WHEN count(*) < 2000 THEN 'small table' WHEN count(*) < 10000 THEN 'mid-size table' "
             "ELSE 'dense locality' END")
    txt = ("CASE WHEN (count(*) - count({c})) / count(*) <= 0.05 THEN 'mode' "
           + ("ELSE 'group_mode' END" if group else "ELSE 'unknown' END"))
    txt_r = ("CASE WHEN (count(*) - count({c})) / count(*) <= 0.05 THEN 'low missing share' "
             + ("ELSE 'group structure present' END" if group else "ELSE 'high missing share' END"))
    cols = [("event_id", "num"), ("ts", "dt"), ("user_id", "num"), ("event_type", "txt"), ("value", "num"),
            ("props", "txt")]
    parts = []
    for i, (c, k) in enumerate(cols):
        if k == "num":
            m, r = num.format(c=c), num_r.format(c=c)
        elif k == "txt":
            m, r = txt.format(c=c), txt_r.format(c=c)
        else:
            m, r = "'flag_only'", "'dates are never imputed'"
        parts.append(_DEC.format(i=i, c=c, method=m, reason=r))
    return f"WITH {EVENTS_NULLS_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("impute_decisions", f"SELECT * REPLACE (round(missing_pct, 6) AS missing_pct) FROM ({_decisions_sql(True)})")
def impute_decisions(spark, sf):
    return round_doubles(imp.decide_methods(events_nulls(spark, sf), group_col="event_type"), 6)


@query("impute_decisions_nogroup",
       f"SELECT * REPLACE (round(missing_pct, 6) AS missing_pct) FROM ({_decisions_sql(False)})")
def impute_decisions_nogroup(spark, sf):
    return round_doubles(imp.decide_methods(events_nulls(spark, sf)), 6)


@query("impute_median", f"""
WITH {EVENTS_NULLS_SQL}
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM ev)), 4) AS value,
       CAST(coalesce(user_id, (SELECT median(user_id) FROM ev)) AS DOUBLE) AS user_id FROM ev
""")
def impute_median(spark, sf):
    out = imp.impute_median(events_nulls(spark, sf), ["value", "user_id"])
    return round_doubles(out.select("event_id", "value", "user_id"), 4)


@query("impute_group_median", f"""
WITH {EVENTS_NULLS_SQL},
g AS (SELECT event_type, median(value) AS gm FROM ev WHERE event_type IS NOT NULL GROUP BY 1),
f AS (SELECT event_id, coalesce(value, gm) AS v FROM ev LEFT JOIN g USING (event_type))
SELECT event_id, round(coalesce(v, (SELECT median(v) FROM f)), 4) AS value FROM f
""")
def impute_group_median(spark, sf):
    out = imp.impute_group_median(events_nulls(spark, sf), "value", "event_type")
    return round_doubles(out.select("event_id", "value"), 4)


_MODE = "(SELECT event_type FROM ev WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)"


@query("impute_mode", f"""
WITH {EVENTS_NULLS_SQL}
SELECT event_id, coalesce(event_type, {_MODE}) AS event_type FROM ev
""")
def impute_mode(spark, sf):
    return imp.impute_mode(events_nulls(spark, sf), "event_type").select("event_id", "event_type")


_CUST_SQL = """cu AS (SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer)"""


def _cust(spark, sf):
    cu = load(spark, sf, "customer")
    return cu.select("c_custkey", "c_nationkey",
                     F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_mktsegment")).alias("segment"))


@query("impute_group_mode", f"""
WITH {_CUST_SQL},
cnt AS (SELECT c_nationkey, segment, count(*) AS n FROM cu WHERE segment IS NOT NULL GROUP BY 1, 2),
gm AS (SELECT c_nationkey, segment AS gm FROM (
         SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, segment) AS r FROM cnt) WHERE r = 1),
f AS (SELECT c_custkey, coalesce(segment, CASE WHEN cu.c_nationkey IS NOT NULL THEN coalesce(gm, 'Unknown') END) AS s
      FROM cu LEFT JOIN gm USING (c_nationkey))
SELECT c_custkey, coalesce(s, (SELECT s FROM f WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1))
       AS segment FROM f
""")
def impute_group_mode(spark, sf):
    return imp.impute_group_mode(_cust(spark, sf), "segment", "c_nationkey").select("c_custkey", "segment")


@query("impute_unknown", f"""
WITH {_CUST_SQL}
SELECT c_custkey, coalesce(segment, 'Unknown') AS segment FROM cu
""")
def impute_unknown(spark, sf):
    return imp.impute_unknown(_cust(spark, sf), "segment").select("c_custkey", "segment")


@query("impute_flag", """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS ts_missing FROM events
""")
def impute_flag(spark, sf):
    ev = load(spark, sf, "events")
    t = ev.select("event_id", F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("ts")).alias("ts"))
    return imp.flag_missing(t, "ts").select("event_id", "ts_missing")


_PSI_SQL = f"""WITH {EVENTS_NULLS_SQL},
o AS (SELECT value AS x FROM ev WHERE value IS NOT NULL),
i AS (SELECT coalesce(value, (SELECT median(value) FROM ev)) AS x FROM ev),
e AS (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM o),
b AS (SELECT k,
        (SELECT count(*) FROM o, e WHERE x >= q[k + 1] AND (x < q[k + 2] OR (k = 9 AND x <= q[k + 2])))
          / (SELECT count(*) FROM o) AS pa,
        (SELECT count(*) FROM i, e WHERE x >= q[k + 1] AND (x < q[k + 2] OR (k = 9 AND x <= q[k + 2])))
          / (SELECT count(*) FROM i) AS pb
      FROM range(10) t(k)),
z AS (SELECT CASE WHEN pa = 0 THEN 0.0001 ELSE pa END AS pa, CASE WHEN pb = 0 THEN 0.0001 ELSE pb END AS pb FROM b)"""


@query("impute_psi", _PSI_SQL + "\nSELECT round(sum((pb - pa) * ln(pb / pa)), 6) AS psi, 10 AS n_bins FROM z")
def impute_psi(spark, sf):
    ev = events_nulls(spark, sf)
    return round_doubles(imp.psi(ev, "value", imp.impute_median(ev, ["value"]), "value"), 6)


@query("impute_psi_equal", """
SELECT 0.0 AS psi, 10 AS n_bins
""".replace("SELECT 0.0 AS psi, 10 AS n_bins", "SELECT round(0.0 * count(*), 6) AS psi, 10 AS n_bins FROM events"))
def impute_psi_equal(spark, sf):
    ev = load(spark, sf, "events")
    return round_doubles(imp.psi(ev, "value", ev, "value"), 6)


@query("impute_ks", f"""
WITH {EVENTS_NULLS_SQL},
o AS (SELECT value AS x FROM ev WHERE value IS NOT NULL),
i AS (SELECT coalesce(value, (SELECT median(value) FROM ev)) AS x FROM ev),
u AS (SELECT x AS v, 1 AS c1, 0 AS c2 FROM o UNION ALL SELECT x, 0, 1 FROM i),
g AS (SELECT v, sum(c1) AS c1, sum(c2) AS c2 FROM u GROUP BY v),
c AS (SELECT sum(c1) OVER (ORDER BY v) / (SELECT count(*) FROM o) AS f1,
             sum(c2) OVER (ORDER BY v) / (SELECT count(*) FROM i) AS f2 FROM g)
SELECT round(max(abs(f1 - f2)), 6) AS ks FROM c
""")
def impute_ks(spark, sf):
    ev = events_nulls(spark, sf)
    return round_doubles(imp.ks_statistic(ev, "value", imp.impute_median(ev, ["value"]), "value"), 6)


@query("impute_completeness", f"""
WITH {EVENTS_NULLS_SQL},
g AS (SELECT event_type, median(value) AS gv, median(user_id) AS gu FROM ev WHERE event_type IS NOT NULL GROUP BY 1),
f AS (SELECT event_id, ts, props, coalesce(value, gv) AS v, coalesce(CAST(user_id AS DOUBLE), gu) AS u,
             coalesce(event_type, {_MODE}) AS t FROM ev LEFT JOIN g USING (event_type)),
h AS (SELECT event_id, ts, props, t, coalesce(v, (SELECT median(v) FROM f)) AS v,
             coalesce(u, (SELECT median(u) FROM f)) AS u FROM f)
SELECT round(1 - (6 * count(*) - count(event_id) - count(ts) - count(props) - count(t) - count(v) - count(u))
             / (count(*) * 6), 4) AS record_completeness FROM h
""")
def impute_completeness(spark, sf):
    return imp.run_imputation(events_nulls(spark, sf), group_col="event_type").completeness()


def _validation_sql(column: str) -> str:
    """PSI over the original's distinct deciles and KS of one imputed column."""
    return f"""SELECT '{column}' AS "column", (SELECT sum((y - x) * ln(y / x)) FROM (SELECT CASE WHEN pa = 0 THEN 0.0001 ELSE pa END AS x, CASE WHEN pb = 0 THEN 0.0001 ELSE pb END AS y FROM
  (SELECT k, (SELECT count(*) FROM ev WHERE {column} >= q[k] AND ({column} < q[k + 1] OR (k = len(q) - 1 AND {column} <= q[k + 1]))) / (SELECT count({column}) FROM ev) AS pa,
          (SELECT count(*) FROM h WHERE {column} >= q[k] AND ({column} < q[k + 1] OR (k = len(q) - 1 AND {column} <= q[k + 1]))) / (SELECT count({column}) FROM h) AS pb
   FROM (SELECT q, unnest(range(1, len(q))) AS k FROM
     (SELECT list_sort(list_distinct(quantile_cont({column}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS q FROM ev))))) AS psi,
  (SELECT max(abs(a / (SELECT count({column}) FROM ev) - b / (SELECT count({column}) FROM h))) FROM (SELECT sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b FROM
     (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT {column} AS v, 1 AS a, 0 AS b FROM ev UNION ALL SELECT {column}, 0, 1 FROM h) WHERE v IS NOT NULL GROUP BY v))) AS ks"""


@query("impute_validation", f"""
WITH {EVENTS_NULLS_SQL},
g AS (SELECT event_type, median(user_id) AS gu FROM ev WHERE event_type IS NOT NULL GROUP BY 1),
e AS (SELECT event_id, ts, props, value, coalesce(CAST(user_id AS DOUBLE), gu) AS u, coalesce(event_type, {_MODE}) AS t FROM ev LEFT JOIN g USING (event_type)),
-- columns are filled in order, so values are grouped by the filled event type
f AS (SELECT e.*, coalesce(value, median(value) OVER (PARTITION BY t)) AS v FROM e),
h AS (SELECT event_id, ts, props, t, coalesce(v, (SELECT median(v) FROM f)) AS value, coalesce(u, (SELECT median(u) FROM f)) AS user_id FROM f),
r AS ({_validation_sql('user_id')} UNION ALL {_validation_sql('value')}),
p AS (SELECT "column", round(psi, 4) AS psi, round(ks, 4) AS ks_statistic, psi <= 0.1 AND ks <= 0.1 AS passed FROM r),
s AS (SELECT CASE WHEN 1 - (6 * count(*) - count(event_id) - count(ts) - count(props) - count(t) - count(value) - count(user_id)) / (count(*) * 6) < 0.8
                    OR (SELECT count(*) FILTER (WHERE NOT passed) > 0.3 * count(*) FROM p) THEN 'STOP'
                  WHEN (SELECT count(*) FILTER (WHERE NOT passed) FROM p) > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM h)
SELECT p.*, status FROM p, s
""")
def impute_validation(spark, sf):
    res = imp.run_imputation(events_nulls(spark, sf), group_col="event_type")
    return res.validation().withColumn("status", F.lit(res.status()))
