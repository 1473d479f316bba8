"""Queries whose input, derived from the tables, reaches branches that the tables as
they are do not: empty rows and columns, dirty headers, decomposed and Arabic letters,
Arabic and mixed cleaning, the Arabic lexicon, a correlation worth a highlight."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles
from tessera.operators import assoc
from tessera.operators import quality as qc
from tessera.operators import standardize as std
from tessera.operators import text as tx
from tessera.plans.catalog.assoc_queries import _pearson_sql
from tessera.plans.registry import load, query

# ------------------------------------------------------------------ QC-1 .. 4
_DIRTY_SQL = """t AS (SELECT CASE WHEN l_orderkey % 9 <> 0 THEN l_returnflag END AS flag, CASE WHEN l_orderkey % 9 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_orderkey % 9 <> 0 AND l_linenumber > 1 THEN l_linestatus END AS "line status", CAST(NULL AS VARCHAR) AS nothing FROM lineitem)"""


def _dirty(spark, sf):
    li = load(spark, sf, "lineitem")
    kept = F.col("l_orderkey") % 9 != 0
    return li.select(F.when(kept, F.col("l_returnflag")).alias("  flag "), F.when(kept, F.col("l_quantity")).alias("quantity\r"),
                     F.when(kept & (F.col("l_linenumber") > 1), F.col("l_linestatus")).alias("line\nstatus"), F.lit(None).cast("string").alias("nothing"))


@query("qc_fix_dirty_rows", f"""
WITH {_DIRTY_SQL}
SELECT DISTINCT flag, quantity, "line status" FROM t WHERE coalesce(flag, "line status", CAST(quantity AS VARCHAR)) IS NOT NULL
""")
def qc_fix_dirty_rows(spark, sf):
    return qc.auto_fix(_dirty(spark, sf))[0]


@query("qc_fix_dirty_counts", f"""
WITH {_DIRTY_SQL},
f AS (SELECT * FROM t WHERE coalesce(flag, "line status", CAST(quantity AS VARCHAR)) IS NOT NULL)
SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM f) AS empty_rows_removed,
       (SELECT count(*) FROM f) - (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS duplicate_rows_removed,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM f)) AS rows_after
""")
def qc_fix_dirty_counts(spark, sf):
    return qc.fix_counts(_dirty(spark, sf))


@query("qc_fix_dirty_report", f"""
WITH {_DIRTY_SQL}
SELECT 'empty_columns_removed' AS fix, (count(flag) = 0)::INT + (count(quantity) = 0)::INT + (count("line status") = 0)::INT + (count(nothing) = 0)::INT AS n FROM t
UNION ALL SELECT 'headers_changed', count(*) FILTER (WHERE trim(replace(replace(h, chr(10), ' '), chr(13), '')) <> h)
FROM (VALUES ('  flag '), ('quantity' || chr(13)), ('line' || chr(10) || 'status')) AS v (h)
""")
def qc_fix_dirty_report(spark, sf):
    return qc.auto_fix(_dirty(spark, sf))[1]


# ------------------------------------------------------------------ STD-1, STD-2
# fixed values: letters taken apart, Latin letters replaced by Arabic ones
_APART = [("é", "é"), ("ü", "ü"), ("ö", "ö"), ("ñ", "ñ"), ("ç", "ç")]
_LATIN, _ARABIC = "aeioutn", "أإآٱىةب"


def _apart_sql(x: str) -> str:
    for a, b in _APART:
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _apart(c):
    for a, b in _APART:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


@query("text_nfc_decomposed", f"""
SELECT doc_id, nfc_normalize({_apart_sql('text')}) AS text, length({_apart_sql('text')}) - length(nfc_normalize({_apart_sql('text')})) AS joined FROM documents
""")
def text_nfc_decomposed(spark, sf):
    apart = load(spark, sf, "documents").select("doc_id", _apart(F.col("text")).alias("apart"))
    return apart.withColumn("text", std.nfc(F.col("apart"))).select("doc_id", "text", (F.length("apart") - F.length("text")).cast("long").alias("joined"))


_AR_SQL = f"translate(lower(text), '{_LATIN}', '{_ARABIC}')"


def _arabic():
    return F.translate(F.lower("text"), _LATIN, _ARABIC)


@query("arabic_fold_letters", f"""
SELECT conv_id, turn, translate({_AR_SQL}, 'إأآٱىة', 'اااايه') AS text FROM conversations
""")
def arabic_fold_letters(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", std.arabic_fold(_arabic()).alias("text"))


# ------------------------------------------------------------------ TXT-4, TXT-10
def _clean_ar_sql(lower: bool) -> str:
    """Arabic letters with a mark and full-width digits in, cleaned by plain replaces."""
    x = f"replace(replace({_AR_SQL}, 'ب', 'ب' || chr(1614)), ' s', ' ７ﬁ')"
    x = f"lower({x})" if lower else x
    x = f"replace(translate({x}, '{tx.CLEAN_AR_FROM}', '{tx.CLEAN_AR_TO}'), chr(1614), '')"
    x = f"strip_accents(replace(replace({x}, '７', '7'), 'ﬁ', 'fi'))"
    return f"trim(regexp_replace(regexp_replace({x}, '[0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _marked():
    return F.replace(F.replace(_arabic(), F.lit("ب"), F.lit("بَ")), F.lit(" s"), F.lit(" ７ﬁ"))


@query("text_clean_arabic", f"SELECT conv_id, turn, {_clean_ar_sql(False)} AS text FROM conversations")
def text_clean_arabic(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", tx.clean_text(_marked(), "ar").alias("text"))


@query("text_clean_mixed", f"SELECT conv_id, turn, {_clean_ar_sql(True)} AS text FROM conversations")
def text_clean_mixed(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", tx.clean_text(F.translate(_marked(), "bcdghlmr", "BCDGHLMR"), "mixed").alias("text"))


_GOOD, _BAD = tx.POSITIVE_WORDS[0], tx.NEGATIVE_WORDS[0]


def _hits(words):
    return " + ".join(f"contains(t, '{w}')::INT" for w in words)


@query("sentiment_arabic", f"""
WITH c AS (SELECT replace(replace(lower(text), 'the ', '{_GOOD} '), 'in ', '{_BAD} ') AS t FROM conversations),
s AS (SELECT sign(({_hits(tx.POSITIVE_WORDS)}) - ({_hits(tx.NEGATIVE_WORDS)})) AS score FROM c)
SELECT round(count(*) FILTER (WHERE score > 0) / count(*), 4) AS positive_ratio, round(count(*) FILTER (WHERE score = 0) / count(*), 4) AS neutral_ratio,
       round(count(*) FILTER (WHERE score < 0) / count(*), 4) AS negative_ratio, round(avg(score), 4) AS avg_sentiment_score, 'Arabic_RuleBased' AS method_used
FROM s
""")
def sentiment_arabic(spark, sf):
    words = F.replace(F.replace(F.lower("text"), F.lit("the "), F.lit(f"{_GOOD} ")), F.lit("in "), F.lit(f"{_BAD} "))
    return tx.sentiment_rule_based(load(spark, sf, "conversations"), words)


# ------------------------------------------------------------------ COR-7
_REV_COLS = ["l_quantity", "l_extendedprice", "revenue", "discounted", "l_tax"]
_REV_SQL = """rev AS (SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS revenue,
  l_extendedprice * l_discount AS discounted, l_tax FROM lineitem)"""


@query("correlation_highlights_revenue", f"""
WITH {_REV_SQL}
SELECT feature1, feature2, correlation FROM ({_pearson_sql(_REV_COLS, 'rev')})
WHERE abs(correlation) >= 0.25 ORDER BY abs(correlation) DESC, feature1, feature2 LIMIT 8
""")
def correlation_highlights_revenue(spark, sf):
    li = load(spark, sf, "lineitem")
    rev = li.select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
                    (F.col("l_extendedprice") * F.col("l_discount")).alias("discounted"), "l_tax")
    return assoc.highlights(assoc.pearson_pairs(rev, _REV_COLS, with_p=False))


# ------------------------------------------------------------------ IMP-11
@query("impute_psi_shifted", """
WITH o AS (SELECT value AS x FROM events WHERE value IS NOT NULL), i AS (SELECT value * 1.5 + 3 AS x FROM events WHERE value IS NOT NULL),
e AS (SELECT quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM o),
b AS (SELECT k, (SELECT count(*) FROM o, e WHERE x >= q[k + 1] AND (x < q[k + 2] OR (k = 9 AND x <= q[k + 2]))) / (SELECT count(*) FROM o) AS pa,
        (SELECT count(*) FROM i, e WHERE x >= q[k + 1] AND (x < q[k + 2] OR (k = 9 AND x <= q[k + 2]))) / (SELECT count(*) FROM i) AS pb FROM range(10) t(k)),
z AS (SELECT CASE WHEN pa = 0 THEN 0.0001 ELSE pa END AS pa, CASE WHEN pb = 0 THEN 0.0001 ELSE pb END AS pb FROM b)
SELECT round(sum((pb - pa) * ln(pb / pa)), 6) AS psi, 10 AS n_bins FROM z
""")
def impute_psi_shifted(spark, sf):
    from tessera.operators import impute as imp
    ev = load(spark, sf, "events")
    return round_doubles(imp.psi(ev, "value", ev.withColumn("value", F.col("value") * 1.5 + 3), "value"), 6)


# ------------------------------------------------------------------ IMP-9, IMP-10
# two columns without equal distances: roots of ids, values told apart by id
_PAIR_SQL = """p AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN sqrt(event_id) END AS x, CASE WHEN event_id % 7 <> 0 THEN value + event_id / 1e7 END AS y FROM events)"""


def _pair(spark, sf):
    k = F.col("event_id")
    return load(spark, sf, "events").select("event_id", F.when(k % 5 != 0, F.sqrt(k)).alias("x"), F.when(k % 7 != 0, F.col("value") + k / F.lit(1e7)).alias("y"))


def _near(lacks: str, has: str) -> str:
    """Five nearest donors by the column that a row has; rows with neither get the mean."""
    return f"""SELECT event_id, avg(v) AS v FROM (SELECT a.event_id, b.{lacks} AS v, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.{has} - b.{has})) AS i
  FROM (SELECT event_id, {has} FROM p WHERE {lacks} IS NULL AND {has} IS NOT NULL) a, (SELECT {has}, {lacks} FROM p WHERE {lacks} IS NOT NULL AND {has} IS NOT NULL) b) WHERE i <= 5 GROUP BY 1"""


@query("impute_knn_pairs", f"""
WITH {_PAIR_SQL}, fx AS ({_near('x', 'y')}), fy AS ({_near('y', 'x')})
SELECT p.event_id, round(coalesce(x, fx.v, (SELECT avg(x) FROM p)), 3) AS x, round(coalesce(y, fy.v, (SELECT avg(y) FROM p)), 3) AS y
FROM p LEFT JOIN fx USING (event_id) LEFT JOIN fy USING (event_id)
""")
def impute_knn_pairs(spark, sf):
    from tessera.operators import impute_models
    return round_doubles(impute_models.knn_impute(_pair(spark, sf), ["x", "y"]), 3)


@query("impute_mice_round", """
WITH p AS (SELECT event_id, sqrt(event_id) AS x, CASE WHEN event_id % 7 <> 0 THEN value END AS y FROM events),
s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(y) AS sy, sum(x * y) AS sxy FROM p WHERE y IS NOT NULL),
r AS (SELECT *, 1e-6 * (n + sxx) / 2 AS e FROM s),
b AS (SELECT ((sxx + e) * sy - sx * sxy) / ((n + e) * (sxx + e) - sx * sx) AS b0, ((n + e) * sxy - sx * sy) / ((n + e) * (sxx + e) - sx * sx) AS b1 FROM r)
SELECT event_id, round(x, 4) AS x, round(coalesce(y, b0 + b1 * x), 4) AS y FROM p, b
""")
def impute_mice_round(spark, sf):
    from tessera.operators import impute_models
    k = F.col("event_id")
    ev = load(spark, sf, "events").select("event_id", F.sqrt(k).alias("x"), F.when(k % 7 != 0, F.col("value")).alias("y"))
    return round_doubles(impute_models.chained_regression(ev, ["x", "y"], rounds=1), 4)


# ------------------------------------------------------------------ SRC-6
@query("landing_report_shape", """
SELECT count(*) AS rows, 6 AS columns, true AS smaller_than_text FROM events
""")
def landing_report_shape(spark, sf):
    from tessera.sources import landing
    text, landed = landing.scratch_path(spark, "text"), landing.scratch_path(spark, "landed")
    ev = load(spark, sf, "events")
    ev.select(*[F.col(c).cast("string") for c in ev.columns]).write.csv(text)
    landing.land_parquet(ev, landed)
    return landing.landing_report(spark, text, landed).select("rows", "columns", ((F.col("source_bytes") > F.col("target_bytes"))
                                                                                   & (F.col("compression_ratio") > 1)).alias("smaller_than_text"))


# ------------------------------------------------------------------ KPI-2
@query("kpi_search_healthcare", """
WITH t AS (SELECT date_diff('day', o_orderdate, l_shipdate) AS los, l_returnflag = 'R' AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 0 AS position, 'total_records' AS kpi, count(*)::DOUBLE AS value, NULL AS source_column, NULL AS reason FROM t
UNION ALL SELECT 1, 'total_columns', 3.0, NULL, NULL
UNION ALL SELECT 2, 'total_admissions', count(*)::DOUBLE, NULL, NULL FROM t
UNION ALL SELECT 3, 'avg_los_days', round(avg(los), 4), 'los_days', NULL FROM t
UNION ALL SELECT 4, 'readmission_30d_pct', round(count(*) FILTER (WHERE back) * 100.0 / count(*), 4), 'readmission', NULL FROM t
""")
def kpi_search_healthcare(spark, sf):
    from tessera.operators import kpi
    li, od = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    stays = li.join(od, li.l_orderkey == od.o_orderkey).select(F.col("l_partkey").alias("patient_id"), F.datediff("l_shipdate", "o_orderdate").alias("los_days"),
                                                               F.when(F.col("l_returnflag") == "R", "Yes").otherwise("No").alias("readmission"))
    return round_doubles(kpi.search_kpis(stays, "healthcare"), 4)


@query("kpi_search_retail", """
SELECT 0 AS position, 'total_records' AS kpi, count(*)::DOUBLE AS value, NULL AS source_column, NULL AS reason FROM lineitem
UNION ALL SELECT 1, 'total_columns', 3.0, NULL, NULL
UNION ALL SELECT 2, 'total_orders', count(*)::DOUBLE, NULL, NULL FROM lineitem
UNION ALL SELECT 3, 'gmv', round(sum(l_extendedprice), 4), 'sales_amount', NULL FROM lineitem
UNION ALL SELECT 4, 'aov', round(avg(l_extendedprice), 4), 'sales_amount', NULL FROM lineitem
UNION ALL SELECT 5, 'return_pct', round(count(*) FILTER (WHERE l_returnflag = 'R') * 100.0 / count(*), 4), 'return_state', NULL FROM lineitem
""")
def kpi_search_retail(spark, sf):
    from tessera.operators import kpi
    li = load(spark, sf, "lineitem")
    sold = li.select(F.col("l_partkey").alias("sku_code"), F.col("l_extendedprice").alias("sales_amount"),
                     F.when(F.col("l_returnflag") == "R", "Refund due").otherwise("kept").alias("return_state"))
    return round_doubles(kpi.search_kpis(sold, "retail"), 4)


@query("kpi_search_generic", """
WITH t AS (SELECT CASE WHEN l_linenumber > 2 THEN l_linestatus END AS a, l_quantity AS b FROM lineitem), s AS (SELECT count(*) AS n, count(a) AS f, count(DISTINCT a) + count(DISTINCT b) AS d FROM t)
SELECT 0 AS position, 'total_records' AS kpi, n::DOUBLE AS value, NULL AS source_column, NULL AS reason FROM s
UNION ALL SELECT 1, 'total_columns', 2.0, NULL, NULL
UNION ALL SELECT 2, 'data_quality_score', round(100 - (n - f) * 100.0 / (2 * n), 4), NULL, NULL FROM s
UNION ALL SELECT 3, 'completeness_rate', round(100 - (n - f) * 100.0 / (2 * n), 4), NULL, NULL FROM s
UNION ALL SELECT 4, 'unique_values_ratio', round(d * 100.0 / (2 * n), 4), NULL, NULL FROM s
""")
def kpi_search_generic(spark, sf):
    from tessera.operators import kpi
    li = load(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") > 2, F.col("l_linestatus")).alias("aa"), F.col("l_quantity").alias("bb"))
    return round_doubles(kpi.search_kpis(li, "none"), 4)


# ------------------------------------------------------------------ REC-1
@query("recommendations_other_domains", """
WITH t AS (SELECT (l_returnflag = 'R')::INT AS back, date_diff('day', o_orderdate, l_shipdate) AS los, l_extendedprice AS paid, l_tax * 10 AS roas, l_discount / 10 AS ctr,
                  l_discount * 20 AS liquid FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
k AS (SELECT avg(back) * 100 AS back, avg(los) AS los, avg(paid) AS aov, sum(paid) AS gmv, count(*) AS n, avg(roas) AS roas, avg(ctr) * 100 AS ctr, avg(liquid) AS liquid FROM t)
SELECT 'emarketing' AS domain, 3 AS rule, 'Reallocate spend' AS title, 'high' AS severity FROM k WHERE roas < 1
UNION ALL SELECT 'emarketing', 4, 'Creative refresh needed', 'medium' FROM k WHERE ctr < 1
UNION ALL SELECT 'retail', 5, 'Quality/size review', 'medium' FROM k WHERE back > 8
UNION ALL SELECT 'retail', 6, 'Basket size optimization', 'low' FROM k WHERE aov < gmv / n * 0.8
UNION ALL SELECT 'healthcare', 7, 'Discharge protocol review', 'high' FROM k WHERE back > 15
UNION ALL SELECT 'healthcare', 8, 'Length of stay optimization', 'medium' FROM k WHERE los > 7
UNION ALL SELECT 'finance', 9, 'Tighten underwriting', 'high' FROM k WHERE back > 6
UNION ALL SELECT 'finance', 10, 'Liquidity monitoring', 'high' FROM k WHERE liquid < 1.2
""")
def recommendations_other_domains(spark, sf):
    from tessera.operators import signals
    li, od = load(spark, sf, "lineitem"), load(spark, sf, "orders")
    back = (F.col("l_returnflag") == "R").cast("int")
    t = li.join(od, li.l_orderkey == od.o_orderkey).select(
        back.alias("return_flag"), back.alias("readmission_flag"), back.alias("default_flag"), F.datediff("l_shipdate", "o_orderdate").alias("los_days"),
        F.col("l_extendedprice").alias("order_value"), (F.col("l_tax") * 10).alias("roas"), (F.col("l_discount") / 10).alias("ctr"),
        (F.col("l_discount") * 20).alias("liquidity_ratio"))
    out = None
    for d in ("emarketing", "retail", "healthcare", "finance"):
        part = signals.recommend(t, d).withColumn("domain", F.lit(d))
        out = part if out is None else out.unionByName(part)
    return out.select("domain", "rule", "title", "severity")
