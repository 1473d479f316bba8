"""MRG-1 .. MRG-6."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles, with_row
from tessera.operators import merge as mrg
from tessera.plans.registry import load, query

MERGE_SQL = """m AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
                  o_totalprice AS total_price, o_orderstatus AS order_status FROM orders),
lines AS (SELECT l_orderkey AS order_id, count(*) AS n_lines, sum(l_quantity) AS qty,
                 max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
cust AS (SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
ret AS (SELECT l_orderkey AS order_id, count(*) AS n_lines, sum(l_quantity) AS qty
        FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1),
j AS (SELECT m.*, lines.n_lines, lines.qty, lines.last_ship, cust.name, cust.segment, cust.balance,
             ret.order_id AS ret_key, ret.n_lines AS n_lines_returns, ret.qty AS qty_returns
      FROM m LEFT JOIN lines USING (order_id) LEFT JOIN cust USING (customer_id) LEFT JOIN ret USING (order_id))"""


def _merge(spark, sf):
    od = load(spark, sf, "orders")
    li = load(spark, sf, "lineitem")
    cu = load(spark, sf, "customer")
    main = od.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                     F.col("o_orderdate").alias("order_date"), F.col("o_totalprice").alias("total_price"),
                     F.col("o_orderstatus").alias("order_status"))
    lines = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"), F.max("l_shipdate").alias("last_ship"))
    cust = cu.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                     F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    ret = li.filter(F.col("l_returnflag") != "N").groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("qty"))
    return mrg.merge_tables(main, [("lines", lines, None), ("customers", cust, None), ("returns", ret, None)])


@query("merge_left", f"""
WITH {MERGE_SQL}
SELECT order_id, customer_id, order_date, round(total_price, 4) AS total_price, order_status, n_lines,
       round(qty, 4) AS qty, last_ship, name, segment, round(balance, 4) AS balance, n_lines_returns,
       round(qty_returns, 4) AS qty_returns
FROM j WHERE ret_key IS NOT NULL
""")
def merge_left(spark, sf):
    return round_doubles(_merge(spark, sf).data, 4)


@query("merge_orphans", f"""
WITH {MERGE_SQL}
SELECT order_id, customer_id, order_date, round(total_price, 4) AS total_price, order_status, n_lines,
       round(qty, 4) AS qty, last_ship, name, segment, round(balance, 4) AS balance, n_lines_returns,
       round(qty_returns, 4) AS qty_returns
FROM j WHERE ret_key IS NULL
""")
def merge_orphans(spark, sf):
    return round_doubles(_merge(spark, sf).orphans["returns"], 4)


@query("merge_issues", f"""
WITH {MERGE_SQL},
o1 AS (SELECT count(*) FILTER (WHERE l.order_id IS NULL) AS c, count(*) AS n
       FROM m LEFT JOIN (SELECT DISTINCT order_id FROM lines) l USING (order_id)),
o3 AS (SELECT count(*) FILTER (WHERE r.order_id IS NULL) AS c, count(*) AS n
       FROM m LEFT JOIN (SELECT DISTINCT order_id FROM ret) r USING (order_id)),
iss AS (
  SELECT 1 AS step, 'lines' AS "table", 'orphans' AS issue_type, c AS count, round(c / n, 4) AS percentage,
         CASE WHEN c / n > 0.1 THEN 'stopped' WHEN c / n > 0.02 THEN 'quarantined' ELSE 'flagged' END AS action
  FROM o1 WHERE c > 0
  UNION ALL
  SELECT 3, 'returns', 'orphans', c, round(c / n, 4),
         CASE WHEN c / n > 0.1 THEN 'stopped' WHEN c / n > 0.02 THEN 'quarantined' ELSE 'flagged' END
  FROM o3 WHERE c > 0)
SELECT *, (SELECT CASE WHEN count(*) FILTER (WHERE action = 'stopped') > 0 THEN 'STOP'
                       WHEN count(*) FILTER (WHERE action IN ('quarantined', 'kept_latest')) > 0 THEN 'WARN'
                       ELSE 'PASS' END FROM iss) AS status
FROM iss
""")
def merge_issues(spark, sf):
    res = _merge(spark, sf)
    return res.issues.withColumn("status", F.lit(res.status))


@query("merge_duplicates", """
WITH t AS (SELECT l_orderkey AS order_id, l_shipdate AS ship_date, l_linenumber AS line_no, l_partkey AS part_id,
                  l_suppkey AS supp_id, l_quantity AS qty FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY ship_date DESC NULLS LAST, line_no DESC,
                                   part_id DESC, supp_id DESC, qty DESC) AS rn FROM t)
SELECT order_id, ship_date, line_no, part_id, supp_id, qty FROM r WHERE rn = 1
""")
def merge_duplicates(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_shipdate").alias("ship_date"),
        F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("supp_id"), F.col("l_quantity").alias("qty"))
    return mrg.keep_latest(li, "order_id", "ship_date")


@query("merge_stopped", """
WITH m AS (SELECT o_orderkey AS order_id, o_orderstatus AS order_status FROM orders),
s AS (SELECT l_orderkey AS order_id, l_shipdate AS ship_date, l_quantity AS qty FROM lineitem),
d AS (SELECT count(*) AS n, count(*) - count(DISTINCT order_id) AS dups FROM s),
o AS (SELECT count(*) FILTER (WHERE s.order_id IS NULL) AS c, count(*) AS n FROM m LEFT JOIN s USING (order_id))
SELECT 1 AS step, 'shipments' AS "table", 'duplicates' AS issue_type, dups AS count, round(dups / n, 4) AS percentage,
       CASE WHEN dups / n > 0.1 THEN 'stopped' WHEN dups / n > 0.03 THEN 'kept_latest' ELSE 'flagged' END AS action,
       (SELECT count(*) FROM m LEFT JOIN s USING (order_id)) AS rows_after
FROM d
UNION ALL
SELECT 1, 'shipments', 'orphans', c, round(c / n, 4),
       CASE WHEN c / n > 0.1 THEN 'stopped' WHEN c / n > 0.02 THEN 'quarantined' ELSE 'flagged' END,
       (SELECT count(*) FROM m LEFT JOIN s USING (order_id))
FROM o WHERE c > 0
""")
def merge_stopped(spark, sf):
    od = load(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"),
                                          F.col("o_orderstatus").alias("order_status"))
    sh = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"),
                                            F.col("l_shipdate").alias("ship_date"), F.col("l_quantity").alias("qty"))
    res = mrg.merge_tables(od, [("shipments", sh, "order_id")])
    return with_row(res.issues, res.data.agg(F.count(F.lit(1)).alias("rows_after")))
