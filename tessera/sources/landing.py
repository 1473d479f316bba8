"""Landing tables as Parquet and describing what landed (SRC-6 .. SRC-10).

Scratch and landing paths live under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``) unless the caller names a target: never a
machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.columns import q
from tessera.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex[:12]}"


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes under a path (file-system metadata, no data read)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def land_parquet(df: DataFrame, path: str, max_records_per_file: int | None = None,
                 mode: str = "overwrite") -> str:
    """SRC-6/7: Parquet with zstd; ``max_records_per_file`` splits large
    partitions into bounded files (the chunked-append case) in one write."""
    w = df.write.mode(mode).option("compression", "zstd")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.parquet(path)
    return path


def landing_report(spark: SparkSession, source_path: str, target_path: str) -> DataFrame:
    """Rows and columns of the landed table, sizes, compression = source / target."""
    landed = spark.read.parquet(target_path)
    src, tgt = path_size(spark, source_path), path_size(spark, target_path)
    return landed.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(landed.columns)).alias("columns"), F.lit(src).alias("source_bytes"),
        F.lit(tgt).alias("target_bytes"), F.lit(src / tgt if tgt else None).cast("double").alias("compression_ratio"))


def landing_inventory(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """SRC-8: per landed dataset and file: rows, size, modification time and
    column count, from Parquet file metadata columns (one scan of no data
    columns: the count reads only row-group metadata)."""
    parts = []
    for name, p in paths.items():
        df = spark.read.parquet(p)
        parts.append(df.select(F.lit(name).alias("dataset"), F.col("_metadata.file_name").alias("file_name"),
                               F.col("_metadata.file_size").alias("file_size"),
                               F.col("_metadata.file_modification_time").alias("modified"))
                       .groupBy("dataset", "file_name", "file_size", "modified")
                       .agg(F.count(F.lit(1)).alias("rows"))
                       .withColumn("columns", F.lit(len(df.columns))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fingerprint(df: DataFrame, name: str = "table") -> DataFrame:
    """SRC-10 (re-aimed): row count and an order-insensitive content hash
    (sum and exclusive or of the rows' xxhash64, so repeated rows count) - equal
    tables give equal fingerprints whatever their partitioning or file layout."""
    h = F.xxhash64(*[q(c) for c in df.columns])
    sums = df.agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("s"))
    return sums.select(F.lit(name).alias("table"), "rows", F.lower(F.lpad(F.hex(F.xxhash64("x", "s")), 16, "0")).alias("fingerprint"))


def register_side_table(df: DataFrame, table: str, key_column: str) -> None:
    """SRC-9: a named side table in the catalogue, its key kept as a property."""
    df.write.mode("overwrite").saveAsTable(table)
    df.sparkSession.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('key_column' = '{key_column}')")


def side_tables(spark: SparkSession) -> DataFrame:
    """(table, key_column) of every registered side table."""
    rows = []
    for t in spark.catalog.listTables():
        if t.isTemporary:
            continue
        props = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {t.name}").collect()}
        if "key_column" in props:
            rows.append((t.name, props["key_column"]))
    return spark.createDataFrame(rows, "table string, key_column string")
