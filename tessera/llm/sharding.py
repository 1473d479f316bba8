"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` virtual slots (fixed for the life of the data
set). Bytes are summed per slot, and a small versioned map sends each slot to
a shard. Version 1 deals the slots largest first to the least loaded shard;
a rebalancing edit (``grow``) makes the next version by moving only the slots
that the new shard takes, so no row moves between old shards. Versions are appended
to one stored table; a later run opens the latest and edits it.

DataFrame functions only. The heavy pass is a partial aggregate per slot and
one window per slot; the map has ``SLOTS`` rows whatever the data, which is
the bound of every broadcast here. Ties break by slot number. A null text
counts as no bytes, a null id hashes to one fixed slot per text; equal rows share a
slot unless they are many, then they are dealt by their place in the stored records.
Extra columns are ignored. An empty table gives an empty result
and a map of empty slots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import ensure_checkpoint_dir

SLOTS = 8192
ROW_BYTES = 16
MAP_COLUMNS = ["version", "virtual_slot", "rows", "bytes", "shard"]
MAP_SCHEMA = "version int, virtual_slot int, rows long, bytes long, shard int"


def with_slots(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow record table: id, size in bytes, crc32 of the text, virtual slot.
    The slot hashes the id and the text's crc, so neither copies of one text
    nor a repeated id gather in one slot."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return (df.select(F.col(id_col).alias("doc_id"), text.alias("t"))
              .select("doc_id", (F.octet_length("t") + F.lit(ROW_BYTES)).cast("long").alias("size"),
                      F.crc32(F.col("t").cast("binary")).alias("text_crc32"))
              .withColumn("virtual_slot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int")))


def _spread_copies(records: DataFrame, slots: int) -> DataFrame:
    """Equal rows that hold a good part of a slot's share of the bytes are dealt over
    the slots by their place in the stored table, so that neither a slot's window nor
    the law suffers from them. Such groups are at most 4 x ``slots``: a fixed bound."""
    total = records.agg(F.sum("size")).first()[0] or 0
    limit = total // (4 * slots) + 1
    copies = (records.groupBy("doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > 1) & (F.col("n") * F.col("size") > limit))
              .select(F.xxhash64("doc_id", "text_crc32", "size").alias("key"), F.lit(True).alias("often")))
    place = F.xxhash64(F.substring(F.col("_metadata.file_name"), 1, 10), F.col("_metadata.row_index"))
    own = F.xxhash64("doc_id", "text_crc32", "size")
    return (records.withColumn("key", own).withColumn("place", place).join(F.broadcast(copies), "key", "left")
            .select("doc_id", "size", "text_crc32",
                    F.when(F.col("often"), F.pmod(F.xxhash64("key", "place"), F.lit(slots)).cast("int")).otherwise(F.col("virtual_slot")).alias("virtual_slot")))


def slot_totals(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows and bytes of every slot, empty slots included."""
    spark = records.sparkSession
    t = records.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    return (spark.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
            .join(t, "virtual_slot", "left").fillna(0, ["rows", "bytes"]))


def first_map(totals: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots by falling bytes, each to the shard with the fewest
    bytes so far (lowest number on ties). One fold over an array of ``SLOTS``
    entries - bounded by the slot count, not by the data."""
    loads = F.array_repeat(F.lit(0).cast("long"), shards)
    fold = F.aggregate(
        F.col("s"),
        F.struct(loads.alias("l"), F.array().cast("array<int>").alias("to")),
        lambda st, x: F.struct(
            F.transform(st["l"], lambda v, i: F.when(i == F.array_position(st["l"], F.array_min(st["l"])) - 1,
                                                     v + x["bytes"]).otherwise(v)).alias("l"),
            F.concat(st["to"], F.array((F.array_position(st["l"], F.array_min(st["l"])) - 1).cast("int"))).alias("to")))
    packed = totals.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("k"), "virtual_slot", "rows", "bytes"))).alias("s"))
    return (packed.select(F.explode(F.arrays_zip(F.col("s"), fold["to"].alias("to"))).alias("z"))
            .select(F.lit(1).alias("version"), F.col("z.s.virtual_slot").alias("virtual_slot"), F.col("z.s.rows").alias("rows"),
                    F.col("z.s.bytes").alias("bytes"), F.col("z.to").alias("shard")))


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """Next version for one shard more: each old shard gives slots, smallest
    first, up to a ``1/(shards+1)`` part of its bytes; all others stay."""
    by_shard = Window.partitionBy("shard")
    running = by_shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, 0)
    give = F.sum("bytes").over(running) * (shards + 1) <= F.sum("bytes").over(by_shard)
    return slot_map.select((F.col("version") + 1).alias("version"), "virtual_slot", "rows", "bytes",
                           F.when(give & (F.col("bytes") > 0), F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def store_map(slot_map: DataFrame, path: str | None = None) -> DataFrame:
    """Append the map version(s) to the map table (by default a new one in the
    session's shared folder) and return the appended rows as stored."""
    spark = slot_map.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    slot_map.select(MAP_COLUMNS).coalesce(1).write.mode("append").parquet(path)
    return open_map(spark, path)


def open_map(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version of a stored map; None where there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    every = spark.read.schema(MAP_SCHEMA).parquet(path)
    return every.filter(F.col("version") == every.agg(F.max("version")).first()[0])


def edit_map(slot_map: DataFrame, totals: DataFrame, shards: int, path: str) -> DataFrame:
    """The map grown to ``shards``, one shard and one stored version at a time, by
    the bytes that the slots hold now."""
    have = slot_map.agg(F.max("shard")).first()[0] + 1
    if have > shards:
        raise ValueError(f"the map deals {have} shards; they can only grow")
    for now in range(have, shards):
        current = slot_map.select("version", "virtual_slot", "shard").join(totals, "virtual_slot")
        slot_map = store_map(grow(current, now), path)
    return slot_map


def shard_documents(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with its shard by near-equal bytes (law ``bytes``), its place
    in the shard (``slot``, gapless from 0: rows of the shard's earlier virtual
    slots plus the rank inside its own), and the shard it would have under the
    next map version with one shard more (``regrown_shard``). With ``map_path`` the
    latest stored map is used, edited if it deals fewer shards, or the first is stored there."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/shard-records-{uuid.uuid4().hex}"
    made = with_slots(df, id_col, text_col, slots)
    made.write.parquet(base)
    records = _spread_copies(spark.read.schema(made.schema).parquet(base), slots)
    totals = slot_totals(records, slots).checkpoint()  # SLOTS rows
    stored = open_map(spark, map_path) if map_path else None
    now = store_map(first_map(totals, shards), map_path) if stored is None else edit_map(stored, totals, shards, map_path)
    now = now.select("version", "virtual_slot", "shard").join(totals, "virtual_slot")
    earlier = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    plan = (now.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
            .join(grow(now, shards).select("virtual_slot", F.col("shard").alias("regrown_shard")), "virtual_slot")
            .select("virtual_slot", "version", "shard", "regrown_shard", "before"))
    rank = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (records.withColumn("rn", F.row_number().over(rank))
            .join(F.broadcast(plan), "virtual_slot")  # SLOTS rows, a fixed number
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("before") + F.col("rn") - 1).cast("long").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "regrown_shard",
                    F.col("version").alias("map_version")))
