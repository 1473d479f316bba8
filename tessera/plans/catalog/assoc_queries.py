"""COR-1 .. COR-7, BIZ-1 .. BIZ-3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import assoc
from tessera.operators.profile import pair_list
from tessera.plans.catalog.fixtures import SHIPF_SQL, shipments_features
from tessera.plans.registry import load, query

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
CAT = ["l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "size_band"]


def _pearson_sql(cols, table):
    return "\nUNION ALL\n".join(
        f"SELECT {k} AS pair_idx, '{a}' AS feature1, '{b}' AS feature2, round(corr({a}, {b}), 4) AS correlation, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, 'pearson' AS method FROM {table}"
        for k, a, b in pair_list(cols))


@query("pearson_pairs", _pearson_sql(LI_NUM, "lineitem"))
def pearson_pairs(spark, sf):
    return assoc.pearson_pairs(load(spark, sf, "lineitem"), LI_NUM, with_p=False)


def _pearson_p_sql(cols, table):
    """Two-sided p of Student's t by Simpson's rule over the angle: t = sqrt(dof) tan(angle)."""
    raw = "\nUNION ALL\n".join(f"SELECT {k} AS pair_idx, '{a}' AS feature1, '{b}' AS feature2, corr({a}, {b}) AS r, count({a} + {b}) AS n FROM {table}"
                              for k, a, b in pair_list(cols))
    return f"""
WITH c AS ({raw}), a AS (SELECT *, n - 2 AS dof, atan(abs(r) / sqrt(1 - r * r)) AS low FROM c),
h AS (SELECT *, least(pi() / 2, low + 14 / sqrt(dof)) - low AS wide FROM a),
s AS (SELECT pair_idx, sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(low + wide * i / 2000), 0), dof - 1)) AS s
      FROM h, range(2001) t(i) GROUP BY 1)
SELECT pair_idx, feature1, feature2, round(r, 4) AS correlation, n, 'pearson' AS method,
       round(least(1.0, 2 * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) * wide / 6000 * s), 4) AS p_value
FROM h JOIN s USING (pair_idx)"""


@query("pearson_pvalues", _pearson_p_sql(LI_NUM, "lineitem"))
def pearson_pvalues(spark, sf):
    return assoc.pearson_pairs(load(spark, sf, "lineitem"), LI_NUM)


def _cat_frame(spark, sf):
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        "l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority",
        F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size_band"))


_CAT_SQL = """t AS (SELECT l_returnflag, l_linestatus, o_orderstatus, o_orderpriority,
                  CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size_band
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_CHI_PAIR = """SELECT {k} AS pair_idx, '{a}' AS feature1, '{b}' AS feature2, chi2, dof, n, n_rows, n_cols,
  round(sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))), 4) AS cramers_v FROM (
  SELECT sum(CASE WHEN nr = 2 AND nc = 2 THEN power(abs(o - e) - least(0.5, abs(o - e)), 2)
                  ELSE power(o - e, 2) END / e) AS chi2,
         CAST((max(nr) - 1) * (max(nc) - 1) AS INTEGER) AS dof, max(n) AS n,
         CAST(max(nr) AS INTEGER) AS n_rows, CAST(max(nc) AS INTEGER) AS n_cols
  FROM (SELECT r.v1, c.v2, coalesce(cl.o, 0) AS o, r.rt * c.ct / r.n AS e, r.nr, c.nc, r.n
        FROM (SELECT v1, rt, sum(rt) OVER () AS n, count(*) OVER () AS nr
              FROM (SELECT {a} AS v1, count(*) AS rt FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)) r
        CROSS JOIN (SELECT v2, ct, count(*) OVER () AS nc
              FROM (SELECT {b} AS v2, count(*) AS ct FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1)) c
        LEFT JOIN (SELECT {a} AS v1, {b} AS v2, count(*) AS o FROM t GROUP BY 1, 2) cl
          ON cl.v1 = r.v1 AND cl.v2 = c.v2))"""


def _chi_sql():
    return f"WITH {_CAT_SQL}\n" + "\nUNION ALL\n".join(
        _CHI_PAIR.format(k=k, a=a, b=b) for k, a, b in pair_list(CAT))


@query("chi_square", f"SELECT pair_idx, feature1, feature2, round(chi2, 4) AS chi2, dof, n, n_rows, n_cols, "
                     f"cramers_v FROM ({_chi_sql()})")
def chi_square(spark, sf):
    out = assoc.chi_square_pairs(_cat_frame(spark, sf), CAT, with_p=False)
    return round_doubles(out.withColumn("dof", F.col("dof").cast("int")), 4)


@query("cramers_v", f"SELECT feature1, feature2, cramers_v FROM ({_chi_sql()}) WHERE n >= 10")
def cramers_v(spark, sf):
    out = assoc.chi_square_pairs(_cat_frame(spark, sf), CAT, with_p=False)
    return out.select("feature1", "feature2", F.round("cramers_v", 4).alias("cramers_v"))


@query("chi_square_large", """
WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS a, CAST(l_suppkey AS VARCHAR) AS b FROM lineitem),
     c AS (SELECT a, b, count(*) AS o FROM t WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
     r AS (SELECT a, sum(o) AS rt FROM c GROUP BY 1), k AS (SELECT b, sum(o) AS ct FROM c GROUP BY 1),
     n AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM c)
SELECT 'partkey' AS feature1, 'suppkey' AS feature2,
       round(max(n.n) * (sum(CAST(o AS DOUBLE) * o / (CAST(rt AS DOUBLE) * ct)) - 1), 2) AS chi2,
       CAST((count(DISTINCT c.a) - 1) * (count(DISTINCT c.b) - 1) AS INTEGER) AS dof
FROM c JOIN r USING (a) JOIN k USING (b), n
""")
def chi_square_large(spark, sf):
    keys = load(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("partkey"),
                                              F.col("l_suppkey").cast("string").alias("suppkey"))
    rows = assoc.chi_square_pairs(keys, with_p=False).select("feature1", "feature2", F.round("chi2", 2).alias("chi2"), "dof").collect()  # one pair
    kind = "int" if all(r["dof"] < 1 << 31 for r in rows) else "long"  # many keys give more degrees than an int holds
    return spark.createDataFrame(rows, f"feature1 string, feature2 string, chi2 double, dof {kind}")


# upper tail of chi-square by Simpson's rule over the root of the statistic
@query("chi_square_pvalues", f"""
WITH c AS ({_chi_sql()}),
s AS (SELECT pair_idx, sum(CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(sqrt(chi2) + i * 0.005, dof - 1)
                           * exp(-pow(sqrt(chi2) + i * 0.005, 2) / 2)) AS s FROM c, range(3001) t(i) GROUP BY 1)
SELECT pair_idx, feature1, feature2, round(chi2, 6) AS chi2, dof, n, n_rows, n_cols,
       round(sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))), 6) AS cramers_v, round(2 / (pow(2, dof / 2) * gamma(dof / 2)) * 0.005 / 3 * s, 6) AS p_value FROM c JOIN s USING (pair_idx)
""")
def chi_square_pvalues(spark, sf):
    return round_doubles(assoc.chi_square_pairs(_cat_frame(spark, sf), CAT).withColumn("dof", F.col("dof").cast("int")), 6)


@query("contingency_table", f"""
WITH {_CAT_SQL}
SELECT l_linestatus AS a, size_band AS b, count(*) AS o FROM t GROUP BY 1, 2
""")
def contingency_table(spark, sf):
    cells = assoc.contingency_cells(_cat_frame(spark, sf), [(0, "l_linestatus", "size_band")])
    return cells.select("a", "b", "o")


@query("fdr_bh", """
WITH p AS (SELECT l_partkey AS test_idx, round(avg(l_discount) * 10, 4) AS p_value FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p_value, test_idx) AS rk, count(*) OVER () AS m FROM p)
SELECT test_idx, p_value,
       round(least(1.0, min(p_value * m / rk) OVER (ORDER BY rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6)
         AS p_adjusted
FROM r
""")
def fdr_bh(spark, sf):
    li = load(spark, sf, "lineitem")
    p = li.groupBy(F.col("l_partkey").alias("test_idx")).agg(F.round(F.avg("l_discount") * 10, 4).alias("p_value"))
    return assoc.fdr_bh(p).withColumn("p_adjusted", F.round("p_adjusted", 6))


@query("correlation_report")
def correlation_report(spark, sf):
    li = load(spark, sf, "lineitem")
    od = load(spark, sf, "orders")
    j = li.join(od, li.l_orderkey == od.o_orderkey).withColumn(
        "size_band", F.when(F.col("l_quantity") > 25, "big").otherwise("small"))
    return assoc.correlation_report(j, LI_NUM, CAT)


@query("correlation_highlights", f"""
SELECT feature1, feature2, correlation FROM ({_pearson_sql(LI_NUM, 'lineitem')})
WHERE abs(correlation) >= 0.25 ORDER BY abs(correlation) DESC, feature1, feature2 LIMIT 8
""")
def correlation_highlights(spark, sf):
    return assoc.highlights(assoc.pearson_pairs(load(spark, sf, "lineitem"), LI_NUM, with_p=False))


_BIZ_COLS = ["transit_time", "sla_flag", "rto_flag", "quantity", "price"]


@query("business_conflicts", f"""
WITH {SHIPF_SQL},
c AS ({_pearson_sql(_BIZ_COLS, 'shipf')}),
ex AS (SELECT * FROM (VALUES ('transit_time', 'sla_flag', 'negative'), ('dwell_time', 'transit_time', 'positive'),
                             ('rto_flag', 'sla_flag', 'negative')) AS e(a, b, expected)),
j AS (SELECT c.*, expected FROM c JOIN ex ON least(feature1, feature2) = least(a, b)
                                         AND greatest(feature1, feature2) = greatest(a, b)),
s AS (SELECT *, CASE WHEN expected = 'positive' AND correlation < 0.2 THEN CASE WHEN correlation < 0 THEN 'high' ELSE 'medium' END
                     WHEN expected = 'negative' AND correlation > -0.2 THEN CASE WHEN correlation > 0 THEN 'high' ELSE 'medium' END
                     WHEN expected = 'none' AND abs(correlation) > 0.6 THEN 'medium'
                     WHEN expected = 'unclear' AND abs(correlation) > 0.8 THEN 'low' END AS sev FROM j)
SELECT feature1, feature2, correlation AS observed_correlation, expected AS expected_relationship,
       sev AS conflict_severity, 'pending' AS resolution FROM s WHERE sev IS NOT NULL
""")
def business_conflicts(spark, sf):
    tests = assoc.pearson_pairs(shipments_features(spark, sf), _BIZ_COLS, with_p=False)
    return assoc.business_conflicts(tests, assoc.expectations_frame(spark, "logistics"))


_BIZ_SQL = f"""
WITH {SHIPF_SQL},
c AS ({_pearson_sql(_BIZ_COLS, 'shipf')}),
ex AS (SELECT * FROM (VALUES ('transit_time', 'sla_flag', 'negative'), ('dwell_time', 'transit_time', 'positive'),
                             ('rto_flag', 'sla_flag', 'negative')) AS e(a, b, expected)),
j AS (SELECT c.*, expected FROM c JOIN ex ON least(feature1, feature2) = least(a, b)
                                         AND greatest(feature1, feature2) = greatest(a, b)),
s AS (SELECT *, CASE WHEN expected = 'positive' AND correlation < 0.2 THEN CASE WHEN correlation < 0 THEN 'high' ELSE 'medium' END
                     WHEN expected = 'negative' AND correlation > -0.2 THEN CASE WHEN correlation > 0 THEN 'high' ELSE 'medium' END
                     WHEN expected = 'none' AND abs(correlation) > 0.6 THEN 'medium'
                     WHEN expected = 'unclear' AND abs(correlation) > 0.8 THEN 'low' END AS sev FROM j)
SELECT feature1, feature2, correlation AS observed_correlation, expected AS expected_relationship,
       sev AS conflict_severity, 'pending' AS resolution FROM s WHERE sev IS NOT NULL
"""


@query("business_status", f"""SELECT count(*) FILTER (WHERE conflict_severity = 'high') AS high, count(*) AS n,
  CASE WHEN count(*) FILTER (WHERE conflict_severity = 'high') > 2 THEN 'STOP' WHEN count(*) > 0 THEN 'WARN'
       ELSE 'PASS' END AS status FROM ({_BIZ_SQL})""")
def business_status(spark, sf):
    tests = assoc.pearson_pairs(shipments_features(spark, sf), _BIZ_COLS, with_p=False)
    return assoc.business_status(assoc.business_conflicts(tests, assoc.expectations_frame(spark, "logistics")))


@query("correlation_ranked", f"""
SELECT feature1, feature2, correlation, row_number() OVER (ORDER BY abs(correlation) DESC, feature1, feature2) AS rank
FROM ({_pearson_sql(LI_NUM, 'lineitem')})
""")
def correlation_ranked(spark, sf):
    """COR-6: every pair ranked by |r| (descending)."""
    from pyspark.sql.window import Window
    t = assoc.pearson_pairs(load(spark, sf, "lineitem"), LI_NUM, with_p=False)
    w = Window.orderBy(F.desc(F.abs("correlation")), "feature1", "feature2")  # one row per column pair
    return t.select("feature1", "feature2", "correlation", F.row_number().over(w).alias("rank"))
