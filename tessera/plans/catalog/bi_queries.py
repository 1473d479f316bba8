"""BI-1 .. BI-9 over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import bi
from tessera.plans.registry import load, query

SLICE_FILTER = {"l_extendedprice": {"range": [1000, 50000]}}


@query("bi_aggregate", """
SELECT o_orderpriority,
       round(avg(l_extendedprice), 4) AS mean_l_extendedprice,
       round(quantile_cont(l_extendedprice, 0.9), 4) AS p90_l_extendedprice
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_extendedprice BETWEEN 1000 AND 50000
GROUP BY o_orderpriority
""")
def bi_aggregate(spark, sf):
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    joined = li.join(od, li.l_orderkey == od.o_orderkey)
    spec = {"intent": "aggregate", "metric": "l_extendedprice", "aggregation": ["mean", "p90"],
            "dimension": "o_orderpriority", "filters": SLICE_FILTER}
    return round_doubles(bi.run_query(joined, spec), 4)


@query("bi_aggregate_overall", """
SELECT round(quantile_cont(l_extendedprice, 0.95), 4) AS p95_l_extendedprice,
       round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice,
       round(stddev_samp(l_extendedprice), 4) AS std_l_extendedprice,
       round(sum(l_extendedprice), 2) AS sum_l_extendedprice,
       count(l_extendedprice) AS count_l_extendedprice,
       round(min(l_extendedprice), 4) AS min_l_extendedprice,
       round(max(l_extendedprice), 4) AS max_l_extendedprice
FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus = 'F'
""")
def bi_aggregate_overall(spark, sf):
    li = load(spark, sf, "lineitem")
    out = bi.aggregate(li, "L_ExtendedPrice", ["p95", "median", "std", "sum", "count", "min", "max"],
                       filters={"l_returnflag": {"in": ["A", "R"]}, "l_linestatus": "F",
                                "not_a_column": 3})
    return round_doubles(out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2)), 4)


@query("bi_count_text", """
SELECT o_orderstatus, count(o_orderpriority) AS count_o_orderpriority
FROM orders WHERE o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'
GROUP BY o_orderstatus
""")
def bi_count_text(spark, sf):
    od = load(spark, sf, "orders")
    return bi.aggregate(od, "o_orderpriority", "count", {"o_orderpriority": {"like": "URGENT|HIGH"}},
                        dimension="O_ORDERSTATUS")


@query("bi_compare", """
SELECT l_returnflag, round(avg(l_quantity), 4) AS mean, round(median(l_quantity), 4) AS median,
       count(l_quantity) AS count, round(stddev_samp(l_quantity), 4) AS std
FROM lineitem WHERE l_discount BETWEEN 0.02 AND 0.08
GROUP BY l_returnflag
""")
def bi_compare(spark, sf):
    li = load(spark, sf, "lineitem")
    spec = {"intent": "compare", "metric": "l_quantity", "dimension": "l_returnflag",
            "filters": {"l_discount": {"range": [0.02, 0.08]}}}
    return round_doubles(bi.run_query(li, spec), 4)


@query("bi_trend", """
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS period, round(avg(value), 4) AS mean_value
FROM events WHERE event_type <> 'error'
GROUP BY 1
""")
def bi_trend(spark, sf):
    ev = load(spark, sf, "events")
    spec = {"intent": "trend", "metric": "value", "freq": "D",
            "filters": {"event_type": {"in": ["click", "view", "purchase", "signup"]}}}
    return round_doubles(bi.run_query(ev, spec), 4)


@query("bi_trend_monthly", """
SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS period,
       round(avg(l_quantity), 4) AS mean_l_quantity
FROM lineitem GROUP BY 1
""")
def bi_trend_monthly(spark, sf):
    li = load(spark, sf, "lineitem")
    return round_doubles(bi.trend(li, "l_quantity", "M"), 4)


_OV_NUM = ["o_orderkey", "o_custkey", "o_totalprice"]
_OV_ALL = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
           ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")]


def _overview_sql():
    parts = []
    for i, (c, t) in enumerate(_OV_ALL):
        if c in _OV_NUM:
            stats = (f"round(avg({c}), 4), round(median({c}), 4), round(stddev_samp({c}), 4), "
                     f"round(min({c}), 4), round(max({c}), 4), count(DISTINCT {c})")
        else:
            stats = "NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT"
        parts.append(f"SELECT count(*) AS total_records, {i} AS position, '{c}' AS \"column\", "
                     f"'{t}' AS dtype, count(*) - count({c}) AS missing, {stats} FROM orders")
    cols = ("total_records, position, \"column\", dtype, missing, mean, median, std, min, max, unique_count")
    return (f"SELECT * FROM ({' UNION ALL '.join(parts)}) "
            f"AS t({cols})")


@query("bi_overview", _overview_sql())
def bi_overview(spark, sf):
    od = load(spark, sf, "orders")
    return round_doubles(bi.run_query(od, {"intent": "overview"}), 4)


@query("bi_top_values", """
WITH long AS (
  SELECT 'p_brand' AS "column", p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part
  UNION ALL SELECT 'p_name', p_name FROM part),
counts AS (SELECT "column", value, count(*) AS count FROM long WHERE value IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM counts),
uniq AS (SELECT "column", count(*) AS unique_count FROM counts GROUP BY ALL)
SELECT r."column", value, count, rank, unique_count
FROM ranked r JOIN uniq u ON r."column" = u."column" WHERE rank <= 10
""")
def bi_top_values(spark, sf):
    pt = load(spark, sf, "part")
    return bi.top_values(pt, ["p_brand", "p_type", "p_name"], k=10)


@query("bi_top_groups", """
WITH g AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
t AS (SELECT 'top' AS section, o_custkey, n_orders FROM g ORDER BY n_orders DESC, o_custkey LIMIT 10),
h AS (SELECT 'high' AS section, o_custkey, n_orders FROM g WHERE n_orders >= 20 ORDER BY n_orders DESC, o_custkey LIMIT 3),
l AS (SELECT 'low' AS section, o_custkey, n_orders FROM g WHERE n_orders <= 5 ORDER BY n_orders DESC, o_custkey LIMIT 3),
u AS (SELECT * FROM t UNION ALL SELECT * FROM h UNION ALL SELECT * FROM l)
SELECT section, row_number() OVER (PARTITION BY section ORDER BY n_orders DESC, o_custkey) AS rank,
       CAST(o_custkey AS VARCHAR) AS "group", n_orders AS value
FROM u
""")
def bi_top_groups(spark, sf):
    od = load(spark, sf, "orders")
    grouped = od.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return bi.group_view(grouped, "o_custkey", "n_orders", top=10, high=20, low=5)


@query("bi_group_summary", """
WITH g AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey)
SELECT CAST(sum(n_orders) AS DOUBLE) AS total, count(*) AS n_groups,
       CAST(max(n_orders) AS DOUBLE) AS max_value, round(sum(n_orders) / count(*), 0) AS mean_per_group
FROM g
""")
def bi_group_summary(spark, sf):
    od = load(spark, sf, "orders")
    grouped = od.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return bi.group_summary(grouped, "n_orders")


@query("bi_compare_dummies", """
SELECT 'A' AS level, count(*) FILTER (WHERE l_returnflag = 'A') AS n_true FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT 'N', count(*) FILTER (WHERE l_returnflag = 'N') FROM lineitem WHERE l_linestatus = 'F'
UNION ALL SELECT 'R', count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem WHERE l_linestatus = 'F'
""")
def bi_compare_dummies(spark, sf):
    """BI-5: true counts per dummy column of one attribute (dummies from the
    one-hot encoder)."""
    from tessera.operators import prep
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus")
    p = prep.fit_encoders(li, cat_cols=["l_returnflag"])
    return bi.compare_dummies(prep.transform(li, p, scale=False), "l_returnflag", {"l_linestatus": "F"})
