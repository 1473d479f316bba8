"""SPL-1 .. SPL-4, ENC-1 .. ENC-4, SCL-1 .. SCL-3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import prep
from tessera.plans.registry import load, query


@query("split_random", """
WITH c AS (SELECT count(*) AS n FROM orders),
s AS (SELECT n, CAST(ceil(0.15::DOUBLE * n) AS BIGINT) AS nt FROM c),
v AS (SELECT n, nt, CAST(ceil((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * (n - nt)) AS BIGINT) AS nv FROM s)
SELECT 'test' AS split, nt AS n FROM v UNION ALL SELECT 'validation', nv FROM v
UNION ALL SELECT 'train', n - nt - nv FROM v
""")
def split_random(spark, sf):
    s = prep.random_split(load(spark, sf, "orders"), ["o_orderkey"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))



_ALLOC_SQL = """c AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(0.15::DOUBLE * sum(n)) AS BIGINT) AS nt FROM c),
a AS (SELECT s, n, (SELECT nt FROM t) * n / (SELECT total FROM t) AS raw FROM c),
b AS (SELECT *, least(n, floor(raw)) AS base, raw - floor(raw) AS frac FROM a),
r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, s) AS rk, (SELECT nt FROM t) - sum(base) OVER () AS lft FROM b),
te AS (SELECT s, n, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS tn FROM r),
v0 AS (SELECT CAST(ceil((0.15::DOUBLE / (1 - 0.15::DOUBLE)) * ((SELECT total FROM t) - (SELECT nt FROM t))) AS BIGINT) AS nv),
va AS (SELECT s, n, tn, n - tn AS rest, (SELECT nv FROM v0) * (n - tn) / (SELECT sum(n - tn) FROM te) AS raw FROM te),
vb AS (SELECT *, least(rest, floor(raw)) AS base, raw - floor(raw) AS frac FROM va),
vr AS (SELECT *, row_number() OVER (ORDER BY frac DESC, s) AS rk, (SELECT nv FROM v0) - sum(base) OVER () AS lft FROM vb),
al AS (SELECT s, n, tn, CAST(base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS BIGINT) AS vn FROM vr),
sp AS (SELECT 'test' AS split, s AS o_orderstatus, tn AS n FROM al
       UNION ALL SELECT 'validation', s, vn FROM al
       UNION ALL SELECT 'train', s, n - tn - vn FROM al)"""


@query("split_stratified", f"WITH {_ALLOC_SQL}\nSELECT * FROM sp")
def split_stratified(spark, sf):
    s = prep.stratified_split(load(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    return s.groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("split_distribution", f"""WITH {_ALLOC_SQL}
SELECT split, o_orderstatus AS value, n, round(n / sum(n) OVER (PARTITION BY split), 4) AS share FROM sp""")
def split_distribution(spark, sf):
    s = prep.stratified_split(load(spark, sf, "orders"), "o_orderstatus", ["o_orderkey"])
    return round_doubles(prep.target_distribution(s, "o_orderstatus"), 4)


@query("split_time", """
WITH r AS (SELECT l_shipdate, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i,
                  count(*) OVER () AS n FROM lineitem),
s AS (SELECT l_shipdate, CASE WHEN i < CAST(floor(n * (1 - 0.15::DOUBLE - 0.15::DOUBLE)) AS BIGINT) THEN 'train'
                              WHEN i < CAST(floor(n * (1 - 0.15::DOUBLE)) AS BIGINT) THEN 'validation'
                              ELSE 'test' END AS split FROM r)
SELECT split, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM s GROUP BY 1
""")
def split_time(spark, sf):
    s = prep.time_split(load(spark, sf, "lineitem"), "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first_ts"),
                                  F.max("l_shipdate").alias("last_ts"))


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    [f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in _PRIOS]
    + [f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in ["F", "O", "P"]]) + " FROM orders")
def one_hot(spark, sf):
    od = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    p = prep.fit_encoders(od, cat_cols=["o_orderpriority", "o_orderstatus"])
    return prep.transform(od, p, scale=False)


@query("one_hot_unseen", "SELECT o_orderkey, " + ", ".join(
    [f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in _PRIOS[:3]])
    + " FROM orders")
def one_hot_unseen(spark, sf):
    """Fitted on the three most urgent priorities only: the others are unseen
    at transform time and get all-false dummies."""
    od = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    train = od.filter(F.col("o_orderpriority").isin(_PRIOS[:3]))
    p = prep.fit_encoders(train, cat_cols=["o_orderpriority"])
    return prep.transform(od, p, scale=False)


@query("target_encode", """
WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS value, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
p AS (SELECT avg(y) AS prior FROM t),
s AS (SELECT value, count(*) AS n, avg(y) AS m FROM t GROUP BY 1)
SELECT value, round(CASE WHEN n = 1 THEN prior
                         ELSE prior * (1 - 1 / (1 + exp(-(n - 20) / 1.0))) + m / (1 + exp(-(n - 20) / 1.0)) END, 6) AS enc
FROM s, p
""")
def target_encode(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("part"),
                                            (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    stats, _ = prep.fit_target_encoder(li, "part", "returned")
    return round_doubles(stats, 6)


@query("ordinal_encode", """
SELECT o_orderpriority AS value, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code
FROM orders GROUP BY o_orderpriority
""")
def ordinal_encode(spark, sf):
    od = load(spark, sf, "orders")
    return prep.fit_ordinal(od, "o_orderpriority", ["o_orderkey"])


@query("encoding_choice", """
SELECT 'o_orderstatus' AS "column", 'OHE' AS method, count(DISTINCT o_orderstatus) AS cardinality,
       'Low cardinality (' || count(DISTINCT o_orderstatus) || '<=50)' AS reason FROM orders
UNION ALL
SELECT 'o_comment_key', 'Ordinal', count(DISTINCT CAST(o_custkey AS VARCHAR)), 'Fallback encoding' FROM orders
""")
def encoding_choice(spark, sf):
    od = load(spark, sf, "orders").select("o_orderstatus", F.col("o_custkey").cast("string").alias("o_comment_key"),
                                          "o_orderkey")
    p = prep.fit_encoders(od, cat_cols=["o_orderstatus", "o_comment_key"], order_cols=["o_orderkey"])
    return prep.encoding_report(p, spark)


_SC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("standard_scale", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS center, round(stddev_pop({c}), 6) AS scale FROM lineitem"
    for c in _SC))
def standard_scale(spark, sf):
    st = prep.fit_scaler(load(spark, sf, "lineitem"), _SC, "standard")
    return round_doubles(spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in st.items()],
                                               "column string, center double, scale double"), 6)


@query("standard_scale_values", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
       round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax
FROM lineitem
""")
def standard_scale_values(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    p = prep.EncoderParams(scale_stats=prep.fit_scaler(li, ["l_quantity", "l_tax"], "standard"))
    return round_doubles(prep.transform(li, p), 6)


@query("robust_scale", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", round(median({c}), 6) AS center, "
    f"round(CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END, 6) AS scale FROM orders"
    for c in ["o_totalprice", "o_custkey"]))
def robust_scale(spark, sf):
    st = prep.fit_scaler(load(spark, sf, "orders"), ["o_totalprice", "o_custkey"], "robust")
    return round_doubles(spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in st.items()],
                                               "column string, center double, scale double"), 6)


@query("encode_scale_apply", """
WITH tr AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM tr)
SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice,
       coalesce(o_orderstatus = 'F', false) AS o_orderstatus_F, coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O,
       coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P
FROM orders, st WHERE o_orderdate >= TIMESTAMP '1997-01-01'
""")
def encode_scale_apply(spark, sf):
    """Fit on orders before 1997 (train), apply to the later ones."""
    od = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    train = od.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    test = od.filter(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    p = prep.fit(train.drop("o_orderdate"), cat_cols=["o_orderstatus"], exclude=["o_orderkey"])
    return round_doubles(prep.transform(test.drop("o_orderdate"), p), 6)
