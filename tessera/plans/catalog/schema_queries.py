"""SCH-1 .. SCH-6 on lineitem with some columns turned into text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import schema as sch
from tessera.plans.registry import load, query

_TXT_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(l_quantity AS VARCHAR) AS qty_txt,
  CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%' AS disc_txt,
  strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS ship_txt,
  l_returnflag,
  CASE WHEN l_partkey % 10 = 0 THEN 'n/a' ELSE CAST(l_tax AS VARCHAR) END AS tax_txt
  FROM lineitem)"""


def _txt(spark, sf):
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("string").alias("qty_txt"),
        F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("disc_txt"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("ship_txt"),
        "l_returnflag",
        F.when(F.col("l_partkey") % 10 == 0, "n/a").otherwise(F.col("l_tax").cast("string")).alias("tax_txt"))


_TEXT_COL = """SELECT {i} AS position, '{c}' AS "column", 'string' AS source_type,
  CASE WHEN hit THEN 'timestamp' WHEN num / n >= 0.98 THEN 'double' WHEN d < 50 AND d / n <= 0.8 THEN 'category'
       ELSE 'string' END AS target_type,
  CASE WHEN hit THEN 'datetime' WHEN num / n >= 0.98 THEN 'numeric' WHEN d < 50 AND d / n <= 0.8 THEN 'categorical'
       ELSE 'text' END AS role,
  CASE WHEN hit THEN tsfail WHEN num / n >= 0.98 THEN n - num - z ELSE 0 END AS failures,
  CASE WHEN hit AND (tsfail + z) / n > 0.02 THEN CAST(tsfail + z AS VARCHAR) || ' datetime conversion failures' END
    AS warning
FROM (SELECT count(*) AS n, count(TRY_CAST(replace({c}, '%', '') AS DOUBLE)) AS num, count(DISTINCT {c}) AS d,
             count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS TIMESTAMP) IS NULL) AS tsfail,
             count(*) - count({c}) AS z FROM t),
     (SELECT coalesce(avg(CASE WHEN regexp_matches({c}, '[0-9]') AND regexp_matches({c}, '[-/:TZ]')
              AND TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END), 0) >= 0.5 AS hit
      FROM t WHERE {c} IS NOT NULL)"""


def _plan_sql():
    head = """SELECT 0 AS position, 'l_orderkey' AS "column", 'bigint' AS source_type, 'double' AS target_type,
  'numeric' AS role, 0 AS failures, NULL AS warning
UNION ALL SELECT 1, 'l_linenumber', 'int', 'double', 'numeric', 0, NULL
UNION ALL SELECT 2, 'l_partkey', 'bigint', 'double', 'numeric', 0, NULL
UNION ALL SELECT 3, 'l_suppkey', 'bigint', 'double', 'numeric', 0, NULL"""
    texts = ["qty_txt", "disc_txt", "ship_txt", "l_returnflag", "tax_txt"]
    body = "\nUNION ALL\n".join(_TEXT_COL.format(i=4 + k, c=c) for k, c in enumerate(texts))
    return f"WITH {_TXT_SQL}\n{head}\nUNION ALL\n{body}"


@query("schema_infer", _plan_sql())
def schema_infer(spark, sf):
    return sch.infer_plan(_txt(spark, sf))


@query("schema_cast", f"""
WITH {_TXT_SQL}
SELECT CAST(l_orderkey AS DOUBLE) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
       CAST(l_partkey AS DOUBLE) AS l_partkey, CAST(l_suppkey AS DOUBLE) AS l_suppkey,
       TRY_CAST(qty_txt AS DOUBLE) AS qty_txt, TRY_CAST(replace(disc_txt, '%', '') AS DOUBLE) AS disc_txt,
       TRY_CAST(ship_txt AS TIMESTAMP) AS ship_txt, l_returnflag, tax_txt
FROM t
""")
def schema_cast(spark, sf):
    out, _ = sch.infer_and_cast(_txt(spark, sf))
    # the session zone is UTC, so the parsed instant equals the naive value
    return out.withColumn("ship_txt", F.col("ship_txt").cast("timestamp_ntz"))


@query("schema_roles", """
SELECT * FROM (VALUES (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'), (3, 'o_totalprice', 'numeric'),
                      (4, 'o_orderdate', 'datetime')) AS v(position, "column", role)
UNION ALL
SELECT 2, 'o_orderstatus', 'categorical' FROM orders
HAVING count(DISTINCT o_orderstatus) < 50 AND count(DISTINCT o_orderstatus) / count(*) < 0.5
UNION ALL
SELECT 5, 'o_orderpriority', 'categorical' FROM orders
HAVING count(DISTINCT o_orderpriority) < 50 AND count(DISTINCT o_orderpriority) / count(*) < 0.5
""")
def schema_roles(spark, sf):
    return sch.column_roles(load(spark, sf, "orders"))


@query("schema_table", """
SELECT 0 AS position, 'order_id' AS "column", 'bigint' AS dtype, count(*) > count(order_id) AS nullable, false AS "unique" FROM ev
UNION ALL SELECT 1, 'ts', 'timestamp_ntz', count(*) > count(ts), false FROM ev
UNION ALL SELECT 2, 'value', 'double', count(*) > count(value), false FROM ev
""".replace("FROM ev", "FROM (SELECT event_id AS order_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END "
            "AS value FROM events)"))
def schema_table(spark, sf):
    ev = load(spark, sf, "events")
    t = ev.select(F.col("event_id").alias("order_id"), "ts",
                  F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))
    return sch.schema_table(t)


@query("schema_enforce", """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
       o_orderstatus, o_totalprice, CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderpriority,
       TRY_CAST(o_orderpriority AS DOUBLE) AS priority_value
FROM orders
""")
def schema_enforce(spark, sf):
    od = load(spark, sf, "orders").withColumn("priority_value", F.col("o_orderpriority"))
    out, _ = sch.enforce_types(od)
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("schema_violations", """
WITH t AS (SELECT event_id AS order_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_type FROM events)
SELECT count(*) AS total_rows, 5 AS total_columns,
       (2 * (count(*) - count(order_id)) + count(*) - count(ts) + 2 * (count(*) - count(user_id))
        + count(*) - count(value)) AS schema_violations,
       round((2 * (count(*) - count(order_id)) + count(*) - count(ts) + 2 * (count(*) - count(user_id))
        + count(*) - count(value)) / (count(*) * 5), 6) AS violation_rate,
       CASE WHEN (2 * (count(*) - count(order_id)) + count(*) - count(ts) + 2 * (count(*) - count(user_id))
        + count(*) - count(value)) / (count(*) * 5) > 0.02 THEN 'WARN' ELSE 'OK' END AS status
FROM t
""")
def schema_violations(spark, sf):
    ev = load(spark, sf, "events")
    k = F.col("event_id")
    t = ev.select(k.alias("order_id"), "ts", F.when(k % 3 == 0, None).otherwise(F.col("user_id")).alias("user_id"),
                  F.when(k % 7 == 0, None).otherwise(F.col("value")).alias("value"), "event_type")
    return round_doubles(sch.schema_violations(t), 6)
