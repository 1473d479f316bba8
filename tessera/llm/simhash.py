"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has a bit set when over half of its word shingles'
XXH64 hashes (seed 42) have it. Equal fingerprints are one class; classes whose
fingerprints differ in at most ``BITS`` bits are linked.

Trie join. Two nodes of equal depth are followed down together: their four pairs
of children (three for a node with itself) add one differing bit or none, and a
pair is dropped as soon as the sum passes the budget. A node is a range of the
sorted fingerprints, a level of pairs is a set of arrays, and pairs with few
leaves are compared at once. Budgets 1, 2, ... are run one after the other: a
pair of nodes whose leaves are all linked already is dropped, so the pairs inside
a dense group of near copies are not gone through. A task returns links that span
its components, never all pairs.

Dealing. Of two fingerprints within the budget at least one of ``BITS + 1`` equal
blocks of bits is the same, so for each block the fingerprints are turned to begin
with it and the trie is cut at that block's depth: each goes to ``BITS + 1`` units,
whatever their number. A unit with more than ``limit`` fingerprints is split into
pairs of its subtrees eight bits further down, by the same rule - pairs beyond the
budget are dropped - until every unit is small; the number of such units is at most
the number of fingerprints over ``limit``, which is raised to keep it under
``MOST_HOT``, so that their broadcast is bounded.

Nulls and texts without words have fingerprint zero and are linked like any other.
``component_id`` is the smallest id that can be reached; null ids count as rows
but never as the smallest (all null: null). Repeated rows are one class. Extra
columns are ignored. An empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.textbytes import LOWER, WHITE, sliced, words
from tessera.session import ensure_checkpoint_dir

K = 3
BITS = 3
SEED = 42
LIMIT = 65_536          # fingerprints of a unit
MOST_HOT = 100_000      # classes or units whose lookup is broadcast
STEP = 8                # bits by which an over-full unit is split
LEAVES = 64             # pairs of leaves compared at once
CHUNK = 1 << 20         # node pairs of a level taken at a time
_U = np.uint64
_UNIT = ["turn", "depth", "p", "q"]


def fingerprints(data: np.ndarray, off: np.ndarray, k: int = K) -> np.ndarray:
    """SimHash of each document of a slice."""
    data = LOWER[data]
    start, end, n = words(data, off)
    # words joined by one space: the first white byte after each word stays
    keep = ~WHITE[data]
    keep[1:] |= keep[:-1]
    at = np.concatenate([[0], np.cumsum(keep)])
    flat = np.where(WHITE[data], 0x20, data)[keep].astype(np.uint8).tobytes()
    first = np.concatenate([[0], np.cumsum(n)])
    many = np.where(n >= k, n - k + 1, n > 0)
    doc = np.repeat(np.arange(len(n)), many)
    i = np.arange(len(doc)) + np.repeat(first[:-1] - (np.cumsum(many) - many), many)
    lo, hi = at[start[i]], at[end[np.minimum(i + k, first[doc + 1]) - 1]]
    ones = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(doc), 1 << 17):
        part = slice(a, a + (1 << 17))
        h = np.array([digest(flat[x:y], SEED) for x, y in zip(lo[part].tolist(), hi[part].tolist())], _U)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        edge = np.flatnonzero(np.diff(doc[part], prepend=-1))
        ones[doc[part][edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > many[:, None], axis=1).view(">u8").ravel().astype(_U)


def _prints(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, data, off in sliced(rb.column(1)):
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), pa.array(fingerprints(data, off, k).view(np.int64))], ["id", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, fp long")


def _least_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a with b: every component bears its least place."""
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class TrieJoin:
    """Join of tries over ``keys``, sorted within ranges; ``pairs`` are the roots
    (first range, second range), the same range for a trie with itself."""

    def __init__(self, keys: np.ndarray, pairs: np.ndarray, bits: int = BITS):
        self.keys, self.pairs, self.bits = keys, pairs, bits
        self.label = np.arange(len(keys))
        self.zeros: dict[int, np.ndarray] = {}

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Links that span the components, as places of ``keys``."""
        for budget in range(1, self.bits + 1):
            self._run(budget)
        at = np.flatnonzero(self.label != np.arange(len(self.keys)))
        return at, self.label[at]

    def _before(self, depth: int) -> np.ndarray:
        """Number of keys with a zero at this depth before each place."""
        if depth not in self.zeros:
            self.zeros[depth] = np.concatenate([[0], np.cumsum((self.keys >> _U(63 - depth)) & _U(1) == 0, dtype=np.int32)])
        return self.zeros[depth]

    def _linked(self, alo, ahi, blo, bhi) -> np.ndarray:
        """Node pairs whose leaves all bear one label."""
        return (self.label[alo] == self.label[blo]) & (self.end[alo] >= ahi) & (self.end[blo] >= bhi)

    def _run(self, budget: int) -> None:
        stack = [(0, self.pairs, np.zeros(len(self.pairs), np.int8))]
        while stack:
            new = np.flatnonzero(np.diff(self.label, append=-1))
            self.end = (new + 1)[np.searchsorted(new, np.arange(len(self.label)))]
            depth, nodes, err = stack.pop()
            if len(nodes) > CHUNK:
                stack += [(depth, nodes[CHUNK:], err[CHUNK:])]
                nodes, err = nodes[:CHUNK], err[:CHUNK]
            alo, ahi, blo, bhi = nodes.T
            ok = ~self._linked(alo, ahi, blo, bhi)
            nodes, err = nodes[ok], err[ok]
            alo, ahi, blo, bhi = nodes.T
            few = (ahi - alo) * (bhi - blo) <= LEAVES
            self._compare(nodes[few], budget)
            nodes, err = nodes[~few], err[~few]
            if not len(nodes) or depth == 64:
                continue
            z = self._before(depth)
            alo, ahi, blo, bhi = nodes.T
            am, bm = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
            own = alo == blo
            down = [(alo, am, blo, bm, 0, None), (am, ahi, bm, bhi, 0, None), (alo, am, bm, bhi, 1, None), (am, ahi, blo, bm, 1, ~own)]
            below, errs = [], []
            for xlo, xhi, ylo, yhi, add, only in down:
                ok = (xlo < xhi) & (ylo < yhi) & (err + add <= budget)
                if only is not None:
                    ok &= only
                below.append(np.column_stack([xlo, xhi, ylo, yhi])[ok])
                errs.append((err + add)[ok].astype(np.int8))
            below, errs = np.concatenate(below), np.concatenate(errs)
            if len(below):
                stack.append((depth + 1, below, errs))

    def _compare(self, nodes: np.ndarray, budget: int) -> None:
        alo, ahi, blo, bhi = nodes.T
        wide = bhi - blo
        n = (ahi - alo) * wide
        for lo in range(0, len(nodes), CHUNK // 8):
            part = slice(lo, lo + CHUNK // 8)
            row = np.repeat(np.arange(lo, min(lo + CHUNK // 8, len(nodes))), n[part])
            i = np.arange(len(row)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
            a, b = alo[row] + i // wide[row], blo[row] + i % wide[row]
            near = np.bitwise_count(self.keys[a] ^ self.keys[b]) <= budget
            self.label = _least_labels(self.label, a[near], b[near])


def _unit_links(rows: DataFrame, bits: int) -> DataFrame:
    """Links (a, b) that span the components of every unit of (turn, depth, p, q,
    side, key); some whole units are joined at a time."""
    width = 64 // (bits + 1)

    def turned_back(key: np.ndarray, turn: np.ndarray) -> np.ndarray:
        s = (turn * width).astype(_U)
        return np.where(s == 0, key, (key >> s) | (key << ((_U(64) - s) & _U(63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> pa.RecordBatch:
            turn, depth, p, q, side = (t.column(i).to_numpy() for i in range(5))
            key = t.column(5).to_numpy().view(_U)
            new = np.ones(len(key), bool)
            for c in (turn, depth, p, q):
                new[1:] &= c[1:] == c[:-1]
            new[1:] = ~new[1:]
            first = np.flatnonzero(new)
            stop = np.append(first[1:], len(key))
            mid = first + np.add.reduceat((side == 0).astype(np.int64), first)
            both = p[first] != q[first]
            pairs = np.column_stack([first, mid, np.where(both, mid, first), np.where(both, stop, mid)])
            a, b = TrieJoin(key, pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])], bits).places()
            return pa.RecordBatch.from_arrays([pa.array(turned_back(key[x], turn[x]).view(np.int64)) for x in (a, b)], ["a", "b"])

        held, rows_ = [], 0
        for rb in batches:
            held.append(rb)
            rows_ += rb.num_rows
            if rows_ < 1 << 18:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            unit = [t.column(i).to_numpy() for i in range(4)]
            open_ = np.logical_and.reduce([c == c[-1] for c in unit])  # the last unit may go on
            cut = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if cut:
                yield done(t.slice(0, cut))
            held, rows_ = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if rows_:
            yield done(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "a long, b long")


def _prefix(key, depth: int):
    return F.shiftrightunsigned(key, 64 - depth) if depth < 64 else key


def fingerprint_links(prints: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp`` within ``bits``."""
    spark = prints.sparkSession
    width = 64 // (bits + 1)
    total = prints.count() * (bits + 1)
    limit = max(limit, -(-total // MOST_HOT))
    keys = prints.select(F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("turn"), "fp").select(
        "turn", F.expr(f"case when turn = 0 then fp else shiftleft(fp, turn * {width}) | shiftrightunsigned(fp, 64 - turn * {width}) end").alias("key"))
    keys = keys.withColumn("p", _prefix("key", width))
    hot = keys.groupBy("turn", "p").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).drop("n").checkpoint()
    shape = ["turn", "depth", "p", "q", "side", "key"]

    def unit(df: DataFrame, depth: int) -> DataFrame:
        return df.select("turn", F.lit(depth).alias("depth"), "p", "q", "side", "key")

    if hot.isEmpty():
        rows = unit(keys.select("turn", "p", F.col("p").alias("q"), F.lit(0).alias("side"), "key"), width)
    else:  # at most total / limit <= MOST_HOT units
        rows = unit(keys.join(F.broadcast(hot), ["turn", "p"], "left_anti").select("turn", "p", F.col("p").alias("q"), F.lit(0).alias("side"), "key"), width)
        crowd = keys.join(F.broadcast(hot), ["turn", "p"]).select("turn", "key").checkpoint()
        big, depth = hot.select("turn", "p", F.col("p").alias("q")), width
        while depth < 64 and not big.isEmpty():
            up, depth = depth, min(64, depth + STEP)
            nodes = (crowd.groupBy("turn", _prefix("key", depth).alias("node")).agg(F.count(F.lit(1)).alias("n"))
                     .withColumn("parent", F.shiftrightunsigned("node", depth - up)).checkpoint())
            a = nodes.select("turn", F.col("parent").alias("p"), F.col("node").alias("a"), F.col("n").alias("na"))
            b = nodes.select("turn", F.col("parent").alias("q"), F.col("node").alias("b"), F.col("n").alias("nb"))
            pairs = (big.join(a, ["turn", "p"]).join(b, ["turn", "q"]).filter("(p <> q or a <= b)")
                     .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
                     .select("turn", F.col("a").alias("p"), F.col("b").alias("q"), (F.greatest("na", "nb") > limit).alias("big")).checkpoint())
            small = pairs.filter("not big") if depth < 64 else pairs
            sides = small.select("turn", "p", "q", F.lit(0).alias("side"), F.col("p").alias("node")).unionAll(
                small.filter("p <> q").select("turn", "p", "q", F.lit(1).alias("side"), F.col("q").alias("node")))
            rows = rows.unionAll(unit(crowd.withColumn("node", _prefix("key", depth)).join(sides, ["turn", "node"]), depth))
            big = pairs.filter("big").drop("big")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 20)))
    dealt = rows.select(*shape).repartition(tasks, *_UNIT).sortWithinPartitions(*_UNIT, "side", F.expr("key ^ (1L << 63)"))
    return _unit_links(dealt, bits)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, bits: int = BITS, limit: int = LIMIT,
                   hot_rows: int = 10_000) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/simhash-{uuid.uuid4().hex}"
    made = _prints(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), k)
    made.write.parquet(f"{base}/prints")
    prints = spark.read.schema(made.schema).parquet(f"{base}/prints")
    classes = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")).checkpoint()
    found = fingerprint_links(classes.select("fp"), bits, limit)
    found.write.parquet(f"{base}/links")
    linked = components(spark.read.schema(found.schema).parquet(f"{base}/links"))

    # smallest id of each component; classes of one row without links need no lookup
    rooted = classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", "n", "least", "root")
    lows = rooted.filter("root is not null").groupBy("root").agg(F.min("least").alias("low"))
    named = (rooted.filter("n > 1 or root is not null").join(lows, "root", "left")
             .select("fp", "n", F.coalesce("low", "least").alias("component_id")).checkpoint())
    size = prints.count()
    crowd = F.col("n") > max(hot_rows, size // MOST_HOT)  # so at most MOST_HOT classes
    many, few = named.filter(crowd).drop("n"), named.filter(~crowd).drop("n")
    rest = prints.join(F.broadcast(many.select("fp")), "fp", "left_anti").join(few, "fp", "left") \
                 .select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))
    out = prints.join(F.broadcast(many), "fp").select("id", "fp", "component_id").unionAll(rest)
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
