"""Splits row by row against a plain sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import prep


def cut(rows, sizes, names):
    out, at = [], 0
    for name, size in zip(names, [*sizes, len(rows) - sum(sizes)]):
        out += [(r, name) for r in rows[at:at + size]]
        at += size
    return out


def sizes_of(n, test=0.15, val=0.15):
    a = math.ceil(test * n)
    return a, math.ceil(val / (1 - test) * (n - a))


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_random_split_by_row(spark, n):
    df = spark.range(n).selectExpr("id", "concat('k', id) AS k", "id % 3 AS extra").repartition(3)
    got = {r.k: r.split for r in prep.random_split(df, ["k"], 0.15, 0.15).collect()}
    order = [r.k for r in df.select("k", prep._hash_key(df, ["k"], prep.SEED).alias("h")).orderBy("h").collect()]
    assert got == dict(cut(order, sizes_of(n), ["test", "validation", "train"]))


def test_random_split_of_repeated_keys(spark):
    df = spark.range(1000).selectExpr("id % 4 AS k", "id AS v").repartition(3)
    out = prep.random_split(df, ["k"], 0.15, 0.15)
    n = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert n == {"test": 150, "validation": 150, "train": 700} and out.select("v").distinct().count() == 1000
    whole = {r.k: r.split for r in out.groupBy("k").agg(F.min("split").alias("split"), F.count_distinct("split").alias("c")).filter("c = 1").collect()}
    assert set(whole.values()) == {"train"}  # two keys are cut, or one twice; the rest are training rows


@pytest.mark.parametrize("kind", ["timestamp", "date", "long", "string"])
def test_time_split_by_row(spark, kind):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, rng.randint(0, 40)])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, d int").repartition(3)
    when = {"timestamp": "timestamp_seconds(d * 3600)", "date": "date_add(date'2020-01-01', d)", "long": "cast(d - 20 as long)", "string": "lpad(cast(d as string), 3, '0')"}[kind]
    out = prep.time_split(df.withColumn("t", F.expr(when)), "t", ["id"], 0.15, 0.15)
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    first = int(500 * 0.7)
    assert {r.id: r.split for r in out.collect()} == dict(cut(order, (first, int(500 * 0.85) - first), ["train", "validation", "test"]))
    assert out.columns == ["id", "d", "t", "split"]


@pytest.mark.parametrize("keys", ["id", "id % 40"])
def test_stratified_split_by_row(spark, keys):
    df = spark.range(1300).selectExpr("id", f"{keys} AS k", "IF(id % 50 = 0, NULL, IF(id % 2 = 0, 'hot', concat('t', id * id % 7))) AS t").repartition(3)
    out = prep.stratified_split(df, "t", ["k"], 0.15, 0.15)
    assert out.columns == ["id", "k", "t", "split"] and out.select("id").distinct().count() == 1300
    per = {}
    for r in out.withColumn("h", prep._hash_key(df, ["k"], prep.SEED)).collect():
        per.setdefault(r.t, []).append((r.h, r.split))
    totals = {"test": 0, "validation": 0, "train": 0}
    for rows in per.values():
        rank = {"test": 0, "validation": 1, "train": 2}
        highest = {s: max((h for h, x in rows if x == s), default=None) for s in rank}
        lowest = {s: min((h for h, x in rows if x == s), default=None) for s in rank}
        for s in rows:
            totals[s[1]] += 1
        assert highest["test"] is None or lowest["validation"] is None or highest["test"] <= lowest["validation"]
        assert highest["validation"] is None or lowest["train"] is None or highest["validation"] <= lowest["train"]
        n_test = sum(x == "test" for _, x in rows)
        assert abs(n_test - 0.15 * len(rows)) <= 1
    assert totals == dict(zip(["test", "validation", "train"], [195, 195, 910]))
