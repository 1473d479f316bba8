"""PRF-1 .. PRF-9."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import profile as prf
from tessera.plans.catalog.fixtures import EVENTS_NULLS_SQL, events_nulls, per_column_union
from tessera.plans.registry import load, query

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_ALL_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
              "l_extendedprice", "l_discount", "l_tax"]


@query("profile_numeric", per_column_union(LI_NUM, """SELECT {i} AS position, '{c}' AS "column",
  count({c}) AS count, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median,
  round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
  round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75,
  round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1)), 4) AS skewness,
  round(kurtosis_pop({c}), 4) AS kurtosis
FROM lineitem"""))
def profile_numeric(spark, sf):
    return round_doubles(prf.profile_numeric(load(spark, sf, "lineitem"), LI_NUM), 4)


@query("profile_categorical", f"""
WITH {EVENTS_NULLS_SQL},
long AS (SELECT 'event_type' AS "column", event_type AS value FROM ev
         UNION ALL SELECT 'props', props FROM ev),
counts AS (SELECT "column", value, count(*) AS count FROM long GROUP BY ALL),
uniq AS (SELECT "column", count(*) AS unique_count FROM counts GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value ASC NULLS LAST) AS rank
           FROM counts)
SELECT r."column", unique_count, rank, value, count FROM ranked r JOIN uniq u ON r."column" = u."column"
WHERE rank <= 5
""")
def profile_categorical(spark, sf):
    return prf.profile_categorical(events_nulls(spark, sf), ["event_type", "props"])


EV_COLS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("profile_missing", f"""
WITH {EVENTS_NULLS_SQL}
SELECT * FROM (
""" + per_column_union(EV_COLS, """SELECT {i} AS position, '{c}' AS "column", count(*) - count({c}) AS count,
  round((count(*) - count({c})) / count(*), 4) AS percentage FROM ev""") + """
) WHERE count > 0""")
def profile_missing(spark, sf):
    return round_doubles(prf.profile_missing(events_nulls(spark, sf)), 4)


def _corr_sql():
    pairs = prf.pair_list(LI_ALL_NUM)
    body = "\nUNION ALL\n".join(
        f"SELECT {k} AS k, '{a}' AS col1, '{b}' AS col2, corr({a}, {b}) AS r FROM lineitem" for k, a, b in pairs)
    return f"""SELECT col1, col2, round(r, 4) AS correlation FROM ({body})
WHERE r IS NOT NULL ORDER BY abs(r) DESC, k LIMIT 5"""


@query("profile_corr_top5", _corr_sql())
def profile_corr_top5(spark, sf):
    return round_doubles(prf.correlation_preview(load(spark, sf, "lineitem"), LI_ALL_NUM), 4)


_ISSUE_MISSING = """SELECT {i} AS position, 0 AS check_order,
  CASE WHEN z > 0.2 THEN 'critical' ELSE 'high' END AS severity, '{c}' AS "column",
  CASE WHEN z > 0.2 THEN 'high_missing' ELSE 'moderate_missing' END AS issue_type,
  nz AS affected_rows, round(z, 4) AS affected_pct
FROM (SELECT (count(*) - count({c})) / count(*) AS z, count(*) - count({c}) AS nz FROM ev) WHERE z > 0.1"""

_ISSUE_OUT = """SELECT {i} AS position, 2 AS check_order, 'medium' AS severity, c AS "column",
  'outliers' AS issue_type, o AS affected_rows, round(o / n, 4) AS affected_pct FROM (
  SELECT '{c}' AS c, count({c}) AS n,
    count(*) FILTER (WHERE {c} < q1 - 3 * (q3 - q1) OR {c} > q3 + 3 * (q3 - q1)) AS o
  FROM ev, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ev))
WHERE n >= 10 AND o / n > 0.05"""


def _issues_sql():
    miss = per_column_union(EV_COLS, _ISSUE_MISSING)
    outs = "\nUNION ALL\n".join(_ISSUE_OUT.format(i=EV_COLS.index(c), c=c)
                                for c in ["event_id", "user_id", "value"])
    return f"WITH {EVENTS_NULLS_SQL}\n{miss}\nUNION ALL\n{outs}"


@query("profile_issues", _issues_sql())
def profile_issues(spark, sf):
    return round_doubles(prf.identify_issues(events_nulls(spark, sf)), 4)


@query("profile_issues_cardinality", """
SELECT 1 AS position, 1 AS check_order, 'medium' AS severity, 'c_name' AS "column",
       'high_cardinality' AS issue_type, count(*) AS affected_rows, 1.0 AS affected_pct
FROM customer HAVING count(DISTINCT c_name) + max(CASE WHEN c_name IS NULL THEN 1 ELSE 0 END) > 1000
UNION ALL
SELECT 3, 2, 'medium', 'c_acctbal', 'outliers', o, round(o / n, 4) FROM (
  SELECT count(c_acctbal) AS n,
    count(*) FILTER (WHERE c_acctbal < q1 - 3 * (q3 - q1) OR c_acctbal > q3 + 3 * (q3 - q1)) AS o
  FROM customer, (SELECT quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer))
WHERE o / n > 0.05
""")
def profile_issues_cardinality(spark, sf):
    cu = load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return round_doubles(prf.identify_issues(cu), 4).filter(F.col("column") != "c_custkey")


def _top_issues_sql():
    miss = per_column_union(EV_COLS, _ISSUE_MISSING)
    outs = "\nUNION ALL\n".join(_ISSUE_OUT.format(i=EV_COLS.index(c), c=c)
                                for c in ["event_id", "user_id", "value"])
    return (f"WITH {EVENTS_NULLS_SQL},\niss AS ({miss}\nUNION ALL\n{outs})\n"
            "SELECT *, CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 "
            "ELSE 1 END AS severity_score FROM iss ORDER BY severity_score DESC, check_order, position LIMIT 10")


@query("profile_top_issues", _top_issues_sql())
def profile_top_issues(spark, sf):
    return round_doubles(prf.top_issues(prf.identify_issues(events_nulls(spark, sf))), 4)


_SHORT_NUM = """SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count({c}) AS count,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std,
  round(min({c}), 4) AS min, round(max({c}), 4) AS max,
  NULL::BIGINT AS unique_count, NULL::VARCHAR AS mode, NULL::BIGINT AS mode_count FROM ev"""
_SHORT_TXT = """SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count({c}) AS count,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
  (SELECT count(DISTINCT {c}) FROM ev) AS unique_count,
  (SELECT {c} FROM ev WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
  (SELECT count(*) FROM ev WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_count
FROM ev"""
_SHORT_TS = """SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count({c}) AS count,
  count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BIGINT, NULL::VARCHAR, NULL::BIGINT
FROM ev"""


def _short_sql():
    types = [("event_id", "bigint", _SHORT_NUM), ("ts", "timestamp_ntz", _SHORT_TS),
             ("user_id", "bigint", _SHORT_NUM), ("event_type", "string", _SHORT_TXT),
             ("value", "double", _SHORT_NUM), ("props", "string", _SHORT_TXT)]
    body = "\nUNION ALL\n".join(tpl.format(i=i, c=c, t=t) for i, (c, t, tpl) in enumerate(types))
    return f"WITH {EVENTS_NULLS_SQL}\n{body}"


@query("profile_short", _short_sql())
def profile_short(spark, sf):
    return prf.short_profile(events_nulls(spark, sf))


_DOC_LABELS = """dl AS (SELECT l.doc_id, quality, toxic, text, lang, source, n_chars
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def _doc_labels(spark, sf):
    lb = load(spark, sf, "labels")
    dc = load(spark, sf, "documents")
    return lb.join(dc, "doc_id").select("doc_id", "quality", "toxic", "text", "lang", "source", "n_chars")


@query("target_candidates", f"""
WITH {_DOC_LABELS},
dc AS (SELECT 1 AS position, 'quality' AS name, count(DISTINCT quality) AS nunique FROM dl
       UNION ALL SELECT 2, 'toxic', count(DISTINCT toxic) FROM dl
       UNION ALL SELECT 4, 'lang', count(DISTINCT lang) FROM dl
       UNION ALL SELECT 5, 'source', count(DISTINCT source) FROM dl)
SELECT position, name, nunique, 'binary outcome' AS reason, 'medium' AS confidence
FROM dc WHERE nunique = 2
""")
def target_candidates(spark, sf):
    return prf.target_candidates(_doc_labels(spark, sf), domain="logistics")


@query("target_infer", f"""
WITH {_DOC_LABELS}
SELECT 'quality' AS target, count(DISTINCT quality) AS nunique,
       count(DISTINCT quality) < count(*) AS accepted FROM dl
""")
def target_infer(spark, sf):
    return prf.infer_target(_doc_labels(spark, sf))
