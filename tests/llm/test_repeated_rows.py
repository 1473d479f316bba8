"""A row repeated through a third of the table is dealt over many slots; slot maps
are stored, opened and edited."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, sharding


def frame(spark, extra=0):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(5, 60))), "a") for i in range(1200 + extra)]
    return spark.createDataFrame(rows + [(None, "the same row again and again " * 4, "b")] * 600, "doc_id long, text string, source string").repartition(5)


def test_packing_deals_equal_rows(spark):
    df = frame(spark)
    out = packing.pack(df, slot_tokens=2000).collect()
    assert sum(r.start == 0 for r in out) == 1800
    same = collections.Counter(r.sequence_id for r in out if r.doc_id is None)
    assert len(same) > 3
    fill = collections.defaultdict(list)
    for r in out:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
    base = df.select("doc_id", F.length("text").alias("n_tokens"), F.crc32("text").alias("ids_hash"))
    folder = f"{sharding.ensure_checkpoint_dir(spark)}/rows-{random.getrandbits(60)}"
    base.write.parquet(folder)
    stored = spark.read.parquet(folder)
    total = stored.agg(F.sum("n_tokens")).first()[0]
    slots = packing._slotted(stored, 40, total // 40, total).groupBy("slot").agg(F.sum("n_tokens").alias("n")).collect()
    assert max(r.n for r in slots) < 3 * total / 40


def test_sharding_against_a_plain_fold(spark):
    rows = sharding.shard_documents(frame(spark), 7, slots=256).collect()
    per = collections.Counter()
    for r in rows:
        per[r.virtual_slot] += r.size
    loads, to = [0] * 7, {}
    for slot in sorted(range(256), key=lambda s: (-per[s], s)):
        to[slot] = min(range(7), key=lambda i: (loads[i], i))
        loads[to[slot]] += per[slot]
    assert all(r.shard == to[r.virtual_slot] for r in rows)
    for shard in range(7):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert max(loads) <= 1.05 * min(loads) and len({r.virtual_slot for r in rows if r.doc_id is None}) > 50
    assert all(r.size == 16 + len(("the same row again and again " * 4).encode()) and r.text_crc32 == zlib.crc32(("the same row again and again " * 4).encode())
               for r in rows if r.doc_id is None)


def test_a_stored_map_is_opened_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    named = lambda rows: {r.doc_id: (r.shard, r.regrown_shard, r.map_version) for r in rows if r.doc_id is not None}
    first = named(sharding.shard_documents(frame(spark), 5, slots=256, map_path=path).collect())
    again = named(sharding.shard_documents(frame(spark, 40), 5, slots=256, map_path=path).collect())
    assert {v[2] for v in again.values()} == {1} and all(again[i][0] == first[i][0] for i in first)
    grown = named(sharding.shard_documents(frame(spark), 6, slots=256, map_path=path).collect())
    assert {v[2] for v in grown.values()} == {2}
    assert all(grown[i][0] in (first[i][0], 5) for i in first) and any(v[0] == 5 for v in grown.values())
    assert all(grown[i][0] == first[i][1] for i in first)  # the edit announced by the version before
    stored = spark.read.parquet(path)
    assert {r.version: r["count"] for r in stored.groupBy("version").count().collect()} == {1: 256, 2: 256}
    with pytest.raises(ValueError):
        sharding.shard_documents(frame(spark), 4, slots=256, map_path=path)
