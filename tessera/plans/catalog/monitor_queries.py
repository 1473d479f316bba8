"""MON-2 .. MON-4: drift of the later half of events against the earlier
half (batch), and windowed drift / KPIs over events read as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.quantiles import exact_quantiles
from tessera.functions.util import round_doubles
from tessera.operators import monitor as mon
from tessera.plans.registry import load, query
from tessera.streaming import monitors as sm

_HALVES_SQL = """mid AS (SELECT quantile_cont(epoch_us(ts), 0.5) AS m FROM events),
base AS (SELECT * FROM events WHERE epoch_us(ts) < (SELECT m FROM mid)),
cur AS (SELECT * FROM events WHERE epoch_us(ts) >= (SELECT m FROM mid))"""


def _halves(spark, sf):
    ev = load(spark, sf, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = exact_quantiles(ev.select(us.alias("us")), ["us"], [0.5])["us"][0]
    return ev.filter(us < mid), ev.filter(us >= mid)


def _psi_sql(col, a="base", b="cur"):
    return f"""(SELECT sum((pb - pa) * ln(pb / pa)) FROM (
  SELECT CASE WHEN pa = 0 THEN 0.0001 ELSE pa END AS pa, CASE WHEN pb = 0 THEN 0.0001 ELSE pb END AS pb FROM (
    SELECT (SELECT count(*) FROM {a}, e_{col} WHERE {col} >= q[k + 1] AND ({col} < q[k + 2] OR (k = 9 AND {col} <= q[k + 2])))
             / (SELECT count({col}) FROM {a}) AS pa,
           (SELECT count(*) FROM {b}, e_{col} WHERE {col} >= q[k + 1] AND ({col} < q[k + 2] OR (k = 9 AND {col} <= q[k + 2])))
             / (SELECT count({col}) FROM {b}) AS pb
    FROM range(10) t(k))))"""


def _ks_sql(col, a="base", b="cur"):
    return f"""(SELECT max(abs(f1 - f2)) FROM (
  SELECT sum(c1) OVER (ORDER BY v) / (SELECT count({col}) FROM {a}) AS f1,
         sum(c2) OVER (ORDER BY v) / (SELECT count({col}) FROM {b}) AS f2
  FROM (SELECT v, sum(c1) AS c1, sum(c2) AS c2 FROM (
          SELECT {col} AS v, 1 AS c1, 0 AS c2 FROM {a} WHERE {col} IS NOT NULL
          UNION ALL SELECT {col}, 0, 1 FROM {b} WHERE {col} IS NOT NULL) GROUP BY v)))"""


def _drift_sql():
    cols = ["event_id", "user_id", "value"]
    edges = ",\n".join(f"e_{c} AS (SELECT quantile_cont({c}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) "
                       f"AS q FROM base)" for c in cols)
    rows = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {_psi_sql(c)} AS psi, {_ks_sql(c)} AS ks" for c in cols)
    return f"""WITH {_HALVES_SQL},
{edges},
r AS ({rows})
SELECT feature, round(psi, 6) AS psi, round(ks, 6) AS ks,
       CASE WHEN psi > 0.25 OR ks > 0.2 THEN 'act' WHEN psi > 0.1 OR ks > 0.1 THEN 'warn' ELSE 'ok' END AS status
FROM r"""


@query("drift_check", _drift_sql())
def drift_check(spark, sf):
    base, cur = _halves(spark, sf)
    return mon.drift_check(base, cur, ["event_id", "user_id", "value"])


@query("drift_stream", f"""
WITH {_HALVES_SQL},
e AS (SELECT quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM base),
bs AS (SELECT k AS bin, (SELECT count(*) FROM base, e WHERE value >= q[k + 1] AND (value < q[k + 2] OR (k = 9 AND value <= q[k + 2])))
                        / (SELECT count(value) FROM base) AS old FROM range(10) t(k)),
ev AS (SELECT date_trunc('day', ts) AS window_start,
              (SELECT max(k) FROM range(10) t(k), e WHERE value >= q[k + 1] AND (value < q[k + 2] OR (k = 9 AND value <= q[k + 2]))) AS bin
       FROM events WHERE value IS NOT NULL),
tot AS (SELECT window_start, count(*) AS total FROM ev GROUP BY 1),
c AS (SELECT window_start, bin, count(*) AS n FROM ev WHERE bin IS NOT NULL GROUP BY 1, 2),
g AS (SELECT tot.window_start, bs.bin, total, coalesce(n, 0) / total AS new, old
      FROM tot CROSS JOIN bs LEFT JOIN c ON c.window_start = tot.window_start AND c.bin = bs.bin)
SELECT CAST(window_start AS TIMESTAMP) AS window_start,
       round(sum((CASE WHEN new = 0 THEN 0.0001 ELSE new END - CASE WHEN old = 0 THEN 0.0001 ELSE old END)
                 * ln(CASE WHEN new = 0 THEN 0.0001 ELSE new END / CASE WHEN old = 0 THEN 0.0001 ELSE old END)), 6) AS psi,
       first(total) AS n
FROM g GROUP BY 1
""")
def drift_stream(spark, sf):
    base, _ = _halves(spark, sf)
    schema = load(spark, sf, "events").schema
    out = sm.drift_stream(spark, sf, schema, "events.parquet", "ts", "value", base)
    return round_doubles(out, 6)


@query("kpi_stream", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS events,
       round(avg(value), 6) AS mean_value,
       round(count(*) FILTER (WHERE event_type = 'purchase') * 100.0 / count(*), 6) AS flag_pct
FROM events GROUP BY 1
""")
def kpi_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    out = sm.kpi_stream(spark, sf, schema, "events.parquet", "ts", "value", F.col("event_type") == "purchase")
    return round_doubles(out, 6)
