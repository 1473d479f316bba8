"""Domain match over a catalogue of (table, column) names (DOM-1 .. DOM-4).

The catalogue is metadata (one row per column of each table); packs and
keywords are small static frames, so every join here is against a table
whose size is fixed by the constants, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.constants import DOMAIN_KEYWORDS, DOMAIN_OK, DOMAIN_PACKS, DOMAIN_WARN


def column_catalog(tables: dict[str, DataFrame], non_empty: bool = True) -> DataFrame:
    """(table, column, position) of the columns each table provides: with
    ``non_empty`` (the default, as after the quality gate drops empty
    columns) only columns holding at least one value, found by one
    aggregate per table over its data."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for t, df in tables.items():
        cols = df.columns
        if not non_empty:
            parts.append(spark.createDataFrame([(t, c, i) for i, c in enumerate(cols)],
                                               "table string, column string, position int"))
            continue
        wide = df.agg(*[F.max(F.col(f"`{c}`").isNotNull().cast("int")).alias(f"h{i}") for i, c in enumerate(cols)])
        parts.append(wide.select(F.explode(F.array(*[
            F.struct(F.lit(t).alias("table"), F.lit(c).alias("column"), F.lit(i).alias("position"),
                     F.coalesce(F.col(f"h{i}"), F.lit(0)).alias("_has")) for i, c in enumerate(cols)])).alias("r"))
                     .select("r.*").filter("_has = 1").drop("_has"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packs_frame(spark: SparkSession) -> DataFrame:
    """DOM-1: (domain, pack_order, expected) for every expected column."""
    rows = [(d, k, c) for k, (d, p) in enumerate(DOMAIN_PACKS.items()) for c in p["expected_columns"]]
    return spark.createDataFrame(rows, "domain string, pack_order int, expected string")


def _scores(catalog: DataFrame) -> DataFrame:
    spark = catalog.sparkSession
    packs = F.broadcast(packs_frame(spark))  # fixed size
    cat = catalog.select("table", F.lower("column").alias("col"))
    n_cols = cat.groupBy("table").agg(F.count(F.lit(1)).alias("n_columns"))
    n_exp = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(k).alias("pack_order"),
                               F.lit(len(p["expected_columns"])).cast("long").alias("n_expected"))
                      for k, (d, p) in enumerate(DOMAIN_PACKS.items())])
    matched = (cat.join(packs, F.col("col") == F.col("expected"))
                  .groupBy("table", "domain")
                  .agg(F.count_distinct("expected").alias("matched"),
                       F.sort_array(F.collect_set("expected")).alias("matched_columns")))
    grid = n_cols.select("table", "n_columns", F.explode(n_exp).alias("d")).select("table", "n_columns", "d.*")
    return grid.join(matched, ["table", "domain"], "left").select(
        "table", "domain", "pack_order", F.coalesce("matched", F.lit(0)).cast("long").alias("matched"),
        "n_expected", "n_columns", F.coalesce("matched_columns", F.array().cast("array<string>")).alias("matched_columns"))


def compatibility(catalog: DataFrame) -> DataFrame:
    """DOM-2: matched / expected per table and domain; >= 0.70 OK, >= 0.30
    WARN, else STOP; with the matched and missing expected columns."""
    spark = catalog.sparkSession
    s = _scores(catalog)
    pct = F.col("matched") / F.col("n_expected")
    exp_lists = packs_frame(spark).groupBy("domain").agg(F.collect_list("expected").alias("_exp"))
    return (s.join(F.broadcast(exp_lists), "domain")
             .select("table", "domain", "matched", "n_expected", F.round(pct, 3).alias("match_pct"),
                     F.when(pct >= DOMAIN_OK, "OK").when(pct >= DOMAIN_WARN, "WARN").otherwise("STOP").alias("status"),
                     "matched_columns",
                     F.filter("_exp", lambda e: ~F.array_contains(F.col("matched_columns"), e)).alias("missing_columns")))


def suggest(catalog: DataFrame) -> DataFrame:
    """DOM-3: 0.5 x (matched/expected + matched/provided), 3 dp, ranked
    descending per table (ties in pack order); rank 1 is the auto choice."""
    s = _scores(catalog)
    score = F.round(0.5 * (F.col("matched") / F.col("n_expected")
                           + F.col("matched") / F.greatest(F.col("n_columns"), F.lit(1))), 3)
    w = Window.partitionBy("table").orderBy(F.desc("score"), "pack_order")
    return s.select("table", "domain", "pack_order", score.alias("score")) \
            .withColumn("rank", F.row_number().over(w)).drop("pack_order")


def keyword_domain(catalog: DataFrame) -> DataFrame:
    """DOM-4: per table, keywords of each domain found in any column name;
    best of the three (ties in list order), 'generic' when nothing is found."""
    spark = catalog.sparkSession
    kw = spark.createDataFrame([(i, d, k) for i, (d, ks) in enumerate(DOMAIN_KEYWORDS.items()) for k in ks],
                               "prio int, domain string, keyword string")
    tables = catalog.select("table").distinct()
    cat = catalog.select("table", F.lower("column").alias("col"))
    hits = (cat.join(F.broadcast(kw), F.col("col").contains(F.col("keyword")))  # fixed-size keyword side
               .groupBy("table", "prio", "domain").agg(F.count_distinct("keyword").alias("score")))
    doms = F.array(*[F.struct(F.lit(i).alias("prio"), F.lit(d).alias("domain"))
                     for i, d in enumerate(DOMAIN_KEYWORDS)])
    grid = tables.select("table", F.explode(doms).alias("d")).select("table", "d.*")
    sc = grid.join(hits, ["table", "prio", "domain"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    w = Window.partitionBy("table").orderBy(F.desc("score"), "prio")
    best = sc.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
    return best.select("table", F.when(F.col("score") > 0, F.col("domain")).otherwise("generic").alias("domain"),
                       F.col("score").cast("long").alias("score"))
