"""SRC-1 .. SRC-10: files written from the driver tables into the shared
scratch folder, then read back through the ingestion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.sources import landing, readers
from tessera.plans.registry import load, query

DIRTY = ["Customer Key", "Customer-Name", "Nation  Key", "Acct Bal ($)", "Mkt Segment"]


def _landed_customer(spark, sf):
    cu = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    src = landing.scratch_path(spark, "customer-csv")
    cu.toDF(*DIRTY).write.option("header", True).csv(src)
    raw = readers.read_source(spark, src + "/*.csv", fmt="csv")
    clean = readers.sanitize_columns(readers.post_process(raw))
    tgt = landing.land_parquet(clean, landing.scratch_path(spark, "customer-parquet"))
    return src, tgt


@query("landing_roundtrip", """
SELECT CAST(c_custkey AS VARCHAR) AS customer_key, c_name AS customer_name, CAST(c_nationkey AS VARCHAR) AS nation_key,
       CAST(c_acctbal AS VARCHAR) AS acct_bal, c_mktsegment AS mkt_segment
FROM customer
""")
def landing_roundtrip(spark, sf):
    _, tgt = _landed_customer(spark, sf)
    return spark.read.parquet(tgt)


@query("landing_report")
def landing_report(spark, sf):
    src, tgt = _landed_customer(spark, sf)
    return landing.landing_report(spark, src, tgt)


_REPAIR_NAMES = ["partkey", "name", "brand", "type"]


def _malformed_part(spark, sf, sep=","):
    """Lines of part as CSV text: an extra field when p_size % 10 = 0, the
    last field missing when p_size % 10 = 1; names quoted with an escaped quote."""
    pt = load(spark, sf, "part")
    name = F.concat(F.lit('"'), F.col("p_name"), F.lit(' ""q"""'))
    base = F.concat_ws(sep, F.col("p_partkey").cast("string"), name, F.col("p_brand"))
    line = (F.when(F.col("p_size") % 10 == 0, F.concat_ws(sep, base, F.col("p_type"), F.lit("extra")))
             .when(F.col("p_size") % 10 == 1, base)
             .otherwise(F.concat_ws(sep, base, F.concat(F.lit("  "), F.col("p_type")))))
    path = landing.scratch_path(spark, "part-text")
    pt.select(line.alias("value")).write.text(path)
    return path


@query("csv_repair", """
SELECT CAST(p_partkey AS VARCHAR) AS partkey, p_name || ' "q"' AS name, p_brand AS brand,
       CASE WHEN p_size % 10 = 1 THEN NULL ELSE p_type END AS type
FROM part
""")
def csv_repair(spark, sf):
    table, _ = readers.repair_csv(spark, _malformed_part(spark, sf), names=_REPAIR_NAMES)
    return table


@query("csv_repair_counts", """
SELECT CASE WHEN p_size % 10 = 0 THEN 'truncated' WHEN p_size % 10 = 1 THEN 'padded' ELSE 'ok' END AS reason,
       count(*) AS rows
FROM part GROUP BY 1
""")
def csv_repair_counts(spark, sf):
    _, counts = readers.repair_csv(spark, _malformed_part(spark, sf), names=_REPAIR_NAMES)
    return counts


@query("csv_good_rows", """
SELECT CAST(p_partkey AS VARCHAR) AS partkey, p_name || ' "q"' AS name, p_brand AS brand,
       CASE WHEN p_size % 10 = 1 THEN NULL ELSE p_type END AS type
FROM part WHERE p_size % 10 <> 0
""")
def csv_good_rows(spark, sf):
    good, _ = readers.read_csv_tolerant(spark, _malformed_part(spark, sf), names=_REPAIR_NAMES)
    return good


@query("csv_rejects", '''
SELECT p_partkey || ',"' || p_name || ' ""q""",' || p_brand || ',' || p_type || ',extra' AS raw_line
FROM part WHERE p_size % 10 = 0
''')
def csv_rejects(spark, sf):
    _, bad = readers.read_csv_tolerant(spark, _malformed_part(spark, sf), names=_REPAIR_NAMES)
    return bad


@query("csv_repair_counts_semicolon", """
SELECT CASE WHEN p_size % 10 = 0 THEN 'truncated' WHEN p_size % 10 = 1 THEN 'padded' ELSE 'ok' END AS reason,
       count(*) AS rows
FROM part GROUP BY 1
""")
def csv_repair_counts_semicolon(spark, sf):
    _, counts = readers.repair_csv(spark, _malformed_part(spark, sf, ";"), sep=";", names=_REPAIR_NAMES)
    return counts


@query("json_source", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def json_source(spark, sf):
    path = landing.scratch_path(spark, "orders-json") + ".json"
    load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").write.json(path)
    return readers.read_source(spark, path)


@query("landing_inventory", """
SELECT 'orders' AS dataset, count(*) AS rows, 6 AS columns FROM orders
UNION ALL SELECT 'customer', count(*), 5 FROM customer
""")
def landing_inventory(spark, sf):
    paths = {}
    for t in ("orders", "customer"):
        paths[t] = landing.land_parquet(load(spark, sf, t), landing.scratch_path(spark, t), max_records_per_file=4000)
    inv = landing.landing_inventory(spark, paths)
    return inv.groupBy("dataset").agg(F.sum("rows").alias("rows"), F.first("columns").alias("columns"))


@query("fingerprint")
def fingerprint(spark, sf):
    parts = [landing.fingerprint(load(spark, sf, t), t) for t in ("orders", "lineitem", "customer", "part")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
