"""Derived inputs shared by catalogue queries, each with its SQL twin.

The driver tables have no nulls, so missing-data queries null out values by
a fixed rule on the key, identically in Spark and in the oracle. No rows are
dropped: the whole table is read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import load


def events_nulls(spark, sf):
    ev = load(spark, sf, "events")
    k = F.col("event_id")
    return ev.select(
        "event_id", "ts",
        F.when(k % 3 == 0, None).otherwise(F.col("user_id")).alias("user_id"),
        F.when(k % 4 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 7 == 0, None).otherwise(F.col("value")).alias("value"),
        "props")


EVENTS_NULLS_SQL = """ev AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
         props
  FROM events)"""


def per_column_union(cols, template):
    """UNION ALL of one SELECT per column; template gets {i} and {c}."""
    return "\nUNION ALL\n".join(template.format(i=i, c=c) for i, c in enumerate(cols))


def shipments(spark, sf):
    """Logistics analogue of lineitem x orders: pickup = order date, delivery
    = ship date, status from the return flag, carrier = supplier."""
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"), "l_partkey",
        F.col("l_suppkey").alias("carrier"), F.col("o_orderdate").alias("pickup_date"),
        F.col("l_shipdate").alias("delivery_date"),
        F.when(F.col("l_returnflag") == "R", "Returned").when(F.col("l_returnflag") == "A", "Delivered")
         .otherwise("Pending").alias("status"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


SHIP_SQL = """ship AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey, l_suppkey AS carrier,
         o_orderdate AS pickup_date, l_shipdate AS delivery_date,
         CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Delivered' ELSE 'Pending' END AS status,
         l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

# logistics features in SQL: transit hours (capped at 240), SLA and return flags
SHIPF_SQL = SHIP_SQL + """,
shipf AS (
  SELECT *, CASE WHEN th > 240 THEN 240.0 ELSE th END AS transit_time,
         CASE WHEN th <= 48 THEN 1 ELSE 0 END AS sla_flag,
         CASE WHEN contains(lower(status), 'return') THEN 1 ELSE 0 END AS rto_flag
  FROM (SELECT *, (epoch_us(delivery_date) - epoch_us(pickup_date)) / 3.6e9 AS th FROM ship))"""


def shipments_features(spark, sf):
    from tessera.operators.features import feature_draft
    out, _, _ = feature_draft(shipments(spark, sf), "logistics")
    return out


def retail_orders(spark, sf):
    """Retail analogue: lineitem x part, quantity x retail price."""
    li = load(spark, sf, "lineitem")
    pt = load(spark, sf, "part")
    return li.join(pt, li.l_partkey == pt.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("l_returnflag") == "R", "Returned").otherwise("Kept").alias("status"))


RETAIL_SQL = """ret AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, l_quantity AS quantity,
         p_retailprice AS price, CASE WHEN l_returnflag = 'R' THEN 'Returned' ELSE 'Kept' END AS status
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def accounts(spark, sf):
    """Finance analogue of orders: open date, balance, default flag."""
    od = load(spark, sf, "orders")
    return od.select(F.col("o_orderkey").alias("account_id"), F.col("o_custkey").alias("customer_id"),
                     F.col("o_orderdate").alias("open_date"), F.col("o_totalprice").alias("balance"),
                     (F.col("o_orderstatus") == "F").cast("int").alias("default_flag"))


ACCOUNTS_SQL = """acc AS (
  SELECT o_orderkey AS account_id, o_custkey AS customer_id, o_orderdate AS open_date,
         o_totalprice AS balance, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS default_flag
  FROM orders)"""


def campaigns(spark, sf):
    """E-marketing analogue: per user of events, views = impressions,
    clicks, purchases = conversions."""
    ev = load(spark, sf, "events")
    t = F.col("event_type")
    return ev.groupBy(F.col("user_id").alias("campaign_id")).agg(
        F.count_if(t == "view").alias("impressions"), F.count_if(t == "click").alias("clicks"),
        F.count_if(t == "purchase").alias("conversions"), F.sum("value").alias("spend"))


CAMPAIGNS_SQL = """camp AS (
  SELECT user_id AS campaign_id, count(*) FILTER (WHERE event_type = 'view') AS impressions,
         count(*) FILTER (WHERE event_type = 'click') AS clicks,
         count(*) FILTER (WHERE event_type = 'purchase') AS conversions, sum(value) AS spend
  FROM events GROUP BY user_id)"""


def patients(spark, sf):
    """Healthcare analogue: admission = order date, discharge = ship date,
    age = account balance / 100 of the customer (some negative: no group)."""
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    cu = load(spark, sf, "customer")
    return (li.join(od, li.l_orderkey == od.o_orderkey).join(cu, od.o_custkey == cu.c_custkey)
              .select(F.col("l_orderkey").alias("patient_id"), F.col("l_linenumber").alias("stay_no"),
                      F.col("l_partkey").alias("ward"),
                      F.col("o_orderdate").alias("admission_ts"), F.col("l_shipdate").alias("discharge_ts"),
                      (F.col("c_acctbal") / 100).alias("age"),
                      (F.col("l_returnflag") == "R").cast("int").alias("readmission_flag")))


PATIENTS_SQL = """pat AS (
  SELECT l_orderkey AS patient_id, l_linenumber AS stay_no, l_partkey AS ward,
         o_orderdate AS admission_ts, l_shipdate AS discharge_ts,
         c_acctbal / 100 AS age, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS readmission_flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""
