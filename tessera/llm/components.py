"""Connected components of a link table, as rounds of two star steps.

Large star: every node sends its larger neighbours to its smallest one. Small
star: every node sends its smaller neighbours, and itself, to the smallest.
The links become stars round the smallest node of each component in a number
of rounds that grows with the logarithm of the longest path. Each round is two
partial aggregates and two joins on the link table (a hot centre is split by
the aggregate and by the skew join) and ends in a reliable checkpoint; only
one number a round, whether anything changed, reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link between different nodes; the root
    is the component's smallest node. Null ends and loops are ignored."""
    ensure_checkpoint_dir(links.sparkSession)
    cur = (links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
           .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct().checkpoint())
    mark = None
    while True:
        cur = _small_star(_large_star(cur)).checkpoint()
        r = cur.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 40)).alias("h")).first()
        if (r["n"], r["h"]) == mark:
            break
        mark = (r["n"], r["h"])
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
