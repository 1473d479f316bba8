"""Suffix-array deduplication with a logarithmic family of indexes.

Every byte covered by a ``MATCH``-byte string that also starts anywhere else is
found, exactly, over all documents; matches never cross documents.

Sparse suffixes. Only suffixes at anchors are indexed: an anchor is the position
with the smallest ``GRAM``-byte hash (the first, if several) among the ``SPAN``
positions of some ``MATCH``-byte string. Every such string holds one, at the same place in all
its copies, so no match is lost, and about two suffixes per ``SPAN`` bytes are
kept. A suffix entry is its key (hash of its first ``GRAM`` bytes, which orders
the array: equal beginnings are neighbours), the hash of its context (the
``SPAN - 1`` bytes before it and ``MATCH`` from it on, cut at the document's
ends - all that any string with this anchor can cover) and how often both occur.

Hash order stands for suffix order: ordering anchors by their bytes would ship 128 and
more bytes for each, where the join needs only to bring equal beginnings together, and
the longest common prefix counts only up to whether it reaches ``GRAM`` bytes (equal
keys) and a whole string (equal contexts, or strings compared by hash below).

The family. Documents arrive in batches. A batch's suffixes are sorted into an
array of their own; it is merge-scanned against the arrays of all levels, and
the entries whose key occurs twice or more are the scan's matches; before
the next batch, arrays of equal level merge into one of the next level, like
digits of a binary counter, so n batches leave about log2(n) arrays, and an
entry is rewritten that often.

Matches become spans. A context that occurs twice or more is repeated as a
whole. For other contexts under a matched key the bytes are fetched, once for
each distinct context, and the strings that hold the anchor at the same place
are compared by hash: for keys with up to ``GROUP`` contexts in one task, for
more by a distributed count over single strings. Only documents with a match
are read again (a bitmap of fixed size keeps the others out of the shuffle).

Nulls are empty texts. Repeated rows are documents of their own, so what they
hold is repeated; a null id takes part as one id. Extra columns are ignored;
an empty table gives an empty result. Levels lie in the shared folder."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.sigtree import NO_ID, _bitmap, _in_bitmap, keyed
from tessera.llm.textbytes import mix, prefix, sliced, spans
from tessera.session import ensure_checkpoint_dir

MATCH = 400
GRAM = 128
SPAN = MATCH - GRAM + 1
BATCHES = 4
GROUP = 4096
HOT = 10_000        # places of a context beyond which it is not a shuffle key
MOST_HOT = 100_000
_U = np.uint64


def anchors(sums: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions of the anchors of all documents of a slice."""
    n = len(sums) - 1
    if n < MATCH:
        return np.zeros(0, np.int64)
    at = np.arange(n - GRAM + 1)
    bits = max(24, n.bit_length())
    low_bits = _U((1 << bits) - 1)
    key = (spans(sums, at, at + GRAM) & ~low_bits) | at.astype(np.uint64)
    # smallest of each window of SPAN positions, from running minima to both sides of block borders
    full = np.full(-(-len(key) // SPAN) * SPAN, ~_U(0))
    full[:len(key)] = key
    ahead = np.minimum.accumulate(full.reshape(-1, SPAN), axis=1).ravel()
    back = np.minimum.accumulate(full.reshape(-1, SPAN)[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - MATCH + 1)
    least = np.minimum(back[:len(start)], ahead[SPAN - 1:SPAN - 1 + len(start)])
    inside = start + MATCH <= off[np.searchsorted(off, start, "right")]
    return np.unique(least[inside] & low_bits).astype(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """Per document: id, text hash, bytes, sha256, and its anchors' positions,
    keys and context hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, data, off in sliced(rb.column(1)):
                sums = prefix(data)
                pos = anchors(sums, off)
                doc = np.searchsorted(off, pos, "right") - 1
                lo, hi = np.maximum(off[doc], pos - SPAN + 1), np.minimum(off[doc + 1], pos + MATCH)
                key = spans(sums, pos, pos + GRAM)
                ctx = mix(spans(sums, lo, hi) + (pos - lo).astype(np.uint64))
                ends = pa.array(np.searchsorted(pos, off).astype(np.int32))
                raw = data.tobytes()
                sha = [hashlib.sha256(raw[off[i]:off[i + 1]]).hexdigest() for i in range(b - a)]
                cols = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (pos - off[doc], key.view(np.int64), ctx.view(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(a, b - a), rb.column(2).slice(a, b - a), pa.array(np.diff(off)),
                     pa.array(sha), *cols], ["id", "t", "n_bytes", "sha", "pos", "key", "ctx"])

    return docs.mapInArrow(run, "id long, t long, n_bytes long, sha string, pos array<long>, key array<long>, ctx array<long>")


class Family:
    """Suffix arrays by level, as written tables under ``base``. A table of the
    levels after each batch is kept beside them, so a family can be opened again,
    in another session too, and take later batches."""

    LEVELS = "turn int, place int, level int, path string"

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base, self.turn = spark, base, 0
        self.levels: list[tuple[int, str, DataFrame]] = []

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> "Family":
        family = cls(spark, base)
        rows = spark.read.schema(cls.LEVELS).parquet(f"{base}/levels").orderBy("turn", "place").collect()  # about log2(turns) rows a turn
        family.turn = rows[-1]["turn"] if rows else 0
        family.levels = [(r["level"], r["path"], spark.read.parquet(r["path"])) for r in rows if r["turn"] == family.turn]
        return family

    def _store(self, df: DataFrame, kind: str) -> tuple[str, DataFrame]:
        path = f"{self.base}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path, self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _array(entries: DataFrame) -> DataFrame:
        """Distinct suffixes with their counts, in key order within partitions."""
        return entries.groupBy("key", "ctx").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "ctx")

    def _merge(self) -> None:
        """Arrays of equal level become one of the next."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (lv, _, x), (_, _, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((lv + 1, *self._store(self._array(x.unionAll(y)), "array")))

    def add(self, suffix: DataFrame) -> DataFrame:
        """Index one batch of (key, ctx) and return the merge scan's matches:
        (key, ctx, whole - the context repeats -, mixed - the key has others, n - its places)."""
        self._merge()
        path, new = self._store(self._array(suffix.withColumn("n", F.lit(1).cast("long"))), "array")
        seen = new
        if self.levels:
            keys = new.select("key").distinct()
            for _, _, level in self.levels:
                seen = seen.unionAll(level.join(keys, "key", "left_semi"))
        entry = seen.groupBy("key", "ctx").agg(F.sum("n").alias("n"))
        twice = entry.groupBy("key").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("ctxs")).filter(F.col("all") >= 2)
        hits = entry.join(twice, "key").select("key", "ctx", (F.col("n") >= 2).alias("whole"), (F.col("ctxs") >= 2).alias("mixed"), "n")
        self.levels.append((0, path, new))
        self.turn += 1
        self.spark.createDataFrame([(self.turn, i, lv, p) for i, (lv, p, _) in enumerate(self.levels)], self.LEVELS).coalesce(1) \
            .write.mode("append").parquet(f"{self.base}/levels")
        return self._store(hits, "hits")[1]


def _contexts(texts: DataFrame) -> DataFrame:
    """(key, whole, id, t, begin, left, bytes) of the wanted contexts of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, ts, wanted = (rb.column(i).to_pylist() for i in range(3))
            for a, b, data, off in sliced(rb.column(3)):
                raw, rows = data.tobytes(), []
                for i in range(a, b):
                    lo, hi = off[i - a], off[i - a + 1]
                    for w in wanted[i]:
                        begin = max(0, w["pos"] - SPAN + 1)
                        rows.append((w["key"], w["whole"], ids[i], ts[i], begin, w["pos"] - begin,
                                     raw[lo + begin:min(hi, lo + w["pos"] + MATCH)]))
                if rows:
                    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     ["key", "whole", "id", "t", "begin", "left", "bytes"])

    return texts.mapInArrow(run, "key long, whole boolean, id long, t long, begin long, left long, bytes binary")


def _strings(key: np.ndarray, left: np.ndarray, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the context, hash with key and place) of every string of a
    context that holds its anchor."""
    from tessera.llm.textbytes import flat
    data, off = flat(col)
    count = np.maximum(np.minimum(left, np.diff(off) - MATCH) + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    s = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    at = off[row] + s
    h = spans(prefix(data), at, at + MATCH)
    return row, s, mix(h + mix((left[row] - s).astype(np.uint64) + key.view(np.uint64)[row]))


def _runs(row: np.ndarray, s: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last start) of the runs of marked strings."""
    row, s = row[hit], s[hit]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], s[at], s[np.append(at[1:], len(row)) - 1] if len(at) else s[:0]


def _compare(rows: DataFrame) -> DataFrame:
    """Spans (id, t, a, b) of repeated strings, key by key within a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            key, whole, ids, ts, begin, left = (t.column(i).to_numpy() for i in range(6))
            row, s, h = _strings(key, left, t.column(6))
            order = np.argsort(h, kind="stable")
            same = np.zeros(len(h), bool)
            eq = h[order][1:] == h[order][:-1]
            same[order[1:][eq]] = True
            same[order[:-1][eq]] = True
            r, first, last = _runs(row, s, same & ~whole[row])
            return pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(ts[r]), pa.array(begin[r] + first),
                                               pa.array(begin[r] + last + MATCH)], ["id", "t", "a", "b"])

        for rb in batches:
            for lo in range(0, rb.num_rows, 1024):
                held.append(rb.slice(lo, 1024))
                if sum(x.num_rows for x in held) < 1024:
                    continue
                t = pa.Table.from_batches(held)
                key = t.column(0).to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if cut:
                    yield done(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return (rows.repartition(F.col("key")).sortWithinPartitions("key")
            .mapInArrow(run, "id long, t long, a long, b long"))


def _compare_large(rows: DataFrame) -> DataFrame:
    """The same for keys with very many contexts: single strings are counted by
    a distributed aggregate, so no task holds a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for lo in range(0, rb.num_rows, 1024):
                p = rb.slice(lo, 1024)
                key, whole, ids, ts, begin, left = (p.column(i).to_numpy(zero_copy_only=False) for i in range(6))
                row, s, h = _strings(key, left, p.column(6))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(whole[row]), pa.array(ids[row]), pa.array(ts[row]),
                                                  pa.array(begin[row] + s)], ["h", "whole", "id", "t", "a"])

    single = rows.mapInArrow(run, "h long, whole boolean, id long, t long, a long")
    twice = single.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("h")
    return single.filter("not whole").join(twice, "h").select("id", "t", "a", (F.col("a") + MATCH).alias("b"))


def _cut(texts: DataFrame) -> DataFrame:
    """(id, t, n_removed, n_spans, kept_sha256) of the texts with spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            ids, ts, found = (rb.column(i).to_pylist() for i in range(3))
            for a, b, data, off in sliced(rb.column(3)):
                rows = []
                for i in range(a, b):
                    text = data[off[i - a]:off[i - a + 1]]
                    step = np.zeros(len(text) + 1, np.int64)
                    for x in found[i]:
                        step[x["a"]] += 1
                        step[x["b"]] -= 1
                    gone = np.cumsum(step[:-1]) > 0
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    rows.append((ids[i], ts[i], int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
                if rows:
                    kinds = [pa.int64()] * 4 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     ["id", "t", "n_removed", "n_spans", "kept_sha256"])

    return texts.mapInArrow(run, "id long, t long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES,
                   group: int = GROUP, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row per input row."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    docs = keyed(df, id_col, text_col)
    made = suffixes(docs)
    made.write.parquet(f"{base}/documents")
    made = spark.read.schema(made.schema).parquet(f"{base}/documents")
    family, hits = Family(spark, base), None
    for i in range(batches):
        part = made.filter(F.pmod(F.xxhash64("id", "t"), F.lit(batches)) == i)
        found = family.add(part.select(F.explode(F.arrays_zip("key", "ctx")).alias("z")).select("z.key", "z.ctx"))
        hits = found if hits is None else hits.unionAll(found)
    hits = hits.groupBy("key", "ctx").agg(F.max("whole").alias("whole"), F.max("mixed").alias("mixed"), F.max("n").alias("n")).checkpoint()

    every = (made.select("id", "t", "n_bytes", F.explode(F.arrays_zip("pos", "key", "ctx")).alias("z"))
             .select("id", "t", "n_bytes", "z.pos", "z.key", "z.ctx"))
    # a frequent context's members are found where they lie: at most MOST_HOT contexts are broadcast
    often = F.col("n") > max(hot, (made.agg(F.sum(F.size("key"))).first()[0] or 0) // MOST_HOT)
    crowded, rest = F.broadcast(hits.filter(often).drop("n")), hits.filter(~often).drop("n")
    members = (every.join(crowded, ["key", "ctx"], "left_anti").join(rest, ["key", "ctx"])
               .unionByName(every.join(crowded, ["key", "ctx"])).checkpoint())
    whole = members.filter("whole").select("id", "t", F.greatest(F.lit(0), F.col("pos") - (SPAN - 1)).alias("a"),
                                           (F.least("pos", F.col("n_bytes") - MATCH) + MATCH).alias("b"))
    # one place of each context under a key with several
    reps = (members.filter("mixed").groupBy("key", "ctx").agg(F.min(F.struct("id", "t", "pos")).alias("m"), F.max("whole").alias("whole"))
            .select("key", "whole", "m.id", "m.t", "m.pos").checkpoint())
    crowd = reps.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group).select("key")
    wanted = reps.groupBy("id", "t").agg(F.collect_list(F.struct("pos", "key", "whole")).alias("w"))
    fetched = _in_bitmap(docs, _bitmap(reps.select("id", "t"))).join(wanted, ["id", "t"]).select("id", "t", "w", "text")
    contexts = _contexts(fetched)
    if crowd.isEmpty():
        partial = _compare(contexts)
    else:
        large = crowd.withColumn("large", F.lit(True))
        marked = contexts.join(large, "key", "left")
        cols = contexts.columns
        partial = _compare(marked.filter("large is null").select(*cols)).unionAll(_compare_large(marked.filter("large").select(*cols)))
    spans_of = (whole.unionAll(partial).distinct().groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("found")).checkpoint())
    texts = _in_bitmap(docs, _bitmap(spans_of.select("id", "t"))).join(spans_of, ["id", "t"]).select("id", "t", "found", "text")
    cut = _cut(texts).dropDuplicates(["id", "t"])
    out = made.select("id", "t", "n_bytes", "sha").join(cut, ["id", "t"], "left")
    return out.select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), "n_bytes",
                      F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
                      F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
