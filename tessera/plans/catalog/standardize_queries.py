"""STD-1 .. STD-4."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import standardize as std
from tessera.plans.registry import load, query

_LOGI_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_suppkey % 4 WHEN 0 THEN 'dhl' WHEN 1 THEN 'DHL Express' WHEN 2 THEN 'ARAMEX' ELSE 'Fedex' END AS carrier,
  CASE l_returnflag WHEN 'R' THEN 'RETURNED' WHEN 'A' THEN 'delivered' ELSE 'In_Transit' END AS status
  FROM lineitem)"""


def _logi(spark, sf):
    li = load(spark, sf, "lineitem")
    k = F.col("l_suppkey") % 4
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.when(k == 0, "dhl").when(k == 1, "DHL Express").when(k == 2, "ARAMEX")
                      .otherwise("Fedex").alias("carrier"),
                     F.when(F.col("l_returnflag") == "R", "RETURNED").when(F.col("l_returnflag") == "A", "delivered")
                      .otherwise("In_Transit").alias("status"))


@query("standardize_values", f"""
WITH {_LOGI_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN carrier IN ('dhl', 'DHL Express') THEN 'DHL' WHEN carrier IN ('aramex', 'ARAMEX') THEN 'Aramex'
       WHEN carrier IN ('smsa', 'SMSA Express') THEN 'SMSA'
       WHEN lower(carrier) = 'dhl' THEN 'DHL' WHEN lower(carrier) = 'aramex' THEN 'Aramex'
       WHEN lower(carrier) = 'smsa' THEN 'SMSA' ELSE carrier END AS carrier,
  CASE WHEN status IN ('delivered', 'DELIVERED') THEN 'Delivered' WHEN status IN ('in_transit', 'IN_TRANSIT') THEN 'In Transit'
       WHEN status = 'pending' THEN 'Pending' WHEN status = 'returned' THEN 'Returned'
       WHEN lower(status) = 'delivered' THEN 'Delivered' WHEN lower(status) = 'in_transit' THEN 'In Transit'
       WHEN lower(status) = 'pending' THEN 'Pending' WHEN lower(status) = 'returned' THEN 'Returned'
       ELSE status END AS status
FROM t
""")
def standardize_values(spark, sf):
    return std.apply_domain_maps(_logi(spark, sf), "logistics")


@query("text_nfc", """
SELECT doc_id, nfc_normalize(text) AS text FROM documents
""")
def text_nfc(spark, sf):
    dc = load(spark, sf, "documents")
    return dc.select("doc_id", std.nfc(F.col("text")).alias("text"))


@query("arabic_fold", """
SELECT conv_id, turn, translate(text, 'إأآٱىة', 'اااايه') AS text FROM conversations
""")
def arabic_fold(spark, sf):
    cv = load(spark, sf, "conversations")
    return cv.select("conv_id", "turn", std.arabic_fold(F.col("text")).alias("text"))


_RARE_SQL = """n AS (SELECT count(*) AS n FROM part),
rb AS (SELECT p_brand AS v FROM part GROUP BY 1 HAVING count(*) / (SELECT n FROM n) <= 0.04),
rt AS (SELECT p_type AS v FROM part GROUP BY 1 HAVING count(*) / (SELECT n FROM n) <= 0.04),
rn AS (SELECT p_name AS v FROM part GROUP BY 1 HAVING count(*) / (SELECT n FROM n) <= 0.04)"""


def _collapse(spark, sf):
    pt = load(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    # limit 1000: the p_name rare set exceeds it and takes the shuffle-join path
    return std.collapse_rare(pt, ["p_brand", "p_type", "p_name"], threshold=0.04)


@query("collapse_rare", f"""
WITH {_RARE_SQL}
SELECT p_partkey,
  CASE WHEN p_brand IN (SELECT v FROM rb) THEN 'Other' ELSE p_brand END AS p_brand,
  CASE WHEN p_type IN (SELECT v FROM rt) THEN 'Other' ELSE p_type END AS p_type,
  CASE WHEN p_name IN (SELECT v FROM rn) THEN 'Other' ELSE p_name END AS p_name
FROM part
""")
def collapse_rare(spark, sf):
    out, _ = _collapse(spark, sf)
    return out


@query("collapse_rare_report", f"""
WITH {_RARE_SQL}
SELECT 'p_brand' AS "column", (SELECT count(*) FROM rb) AS n_collapsed, 0.04 AS threshold
UNION ALL SELECT 'p_type', (SELECT count(*) FROM rt), 0.04
UNION ALL SELECT 'p_name', (SELECT count(*) FROM rn), 0.04
""")
def collapse_rare_report(spark, sf):
    _, rep = _collapse(spark, sf)
    return rep
