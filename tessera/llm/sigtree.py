"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when their Jaccard similarity
reaches NUM/DEN. The result is exact.

1. One pass gives every document its set's size and 64-bit set hash, another the
   first floor(n/4) + c shingles in one global order, c = floor(n/16) + 1: of
   two sets that link, the c-th common shingle is among them in either set, so
   they share c (for the smaller set's c) or more. Shingles that a sample of documents shows to be common come
   last in the order, so that shared passages and license lines do not make
   candidates; the sample touches speed only. Equal sets are one class from here.
2. A shuffle on the shingle puts classes that share one side by side, by size.
   Where up to ``FEW`` do, each pair whose sizes allow a link counts one, and a
   pair with c/2 counts is a candidate (chance meetings have fewer); where more
   do, neighbours by size are joined, among the classes that meet so many at c/2
   of their shingles or more - a pair without them has its c/2 counts elsewhere. The components of these
   candidate links are blocks: no link crosses them. Classes alone are done.
3. The texts of one member of each class that is left are fetched (a bitmap of
   fixed size, broadcast, keeps the rest out of the shuffle) and dealt by block.
4. In a block a signature tree is built: sets ordered by their smallest
   shingles, leaves of ``LEAF`` sets, nodes with the OR of their members' token
   bitmaps, their size range and the largest number of tokens hidden by bitmap
   collisions. A dual traversal descends into a pair of nodes only if the most
   tokens a pair of members can share - bits in common plus hidden tokens, and
   no more than the smaller size - reaches what their sizes ask for, and if the
   members are not yet known to be one component. Surviving pairs of sets are
   verified on the shingles. Hubs (a set compared with all of the block) come
   first, so a large group of near copies is settled by few comparisons rather
   than by all its pairs.
5. The verified links' components give every document its smallest id.

Blocks over ``BLOCK_SETS`` sets or ``BLOCK_TOKENS`` shingles are cut into pages
and every pair of pages is a task of its own, so no task holds more than that
(plus one set, if it alone is larger); the number of tasks grows with the square
of such a block's pages.

Nulls and texts without words are empty sets, linked with nothing (they are
components of their own id). A null id takes part by its text; where all ids of
a component are null so is its number. Repeated ids and rows are documents of
their own. Extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.textbytes import LOWER, mix, prefix, shingles, sliced, spans, words
from tessera.session import ensure_checkpoint_dir

K = 5
NUM, DEN = 75, 100
LEAF, FAN = 32, 8
BLOCK_SETS, BLOCK_TOKENS = 40_000, 6_000_000
SAMPLE = 20_000
SENT = 1 << 16
COMMON = 3
COMMON_MOST = 1 << 18
EXTRA = 16   # leading shingles beyond the quarter: n // EXTRA, and so many must be shared
FEW = 16     # classes with a shingle up to which pairs are counted
BITMAP = 1 << 23
NO_ID = -(1 << 63)
_U = np.uint64


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents, number per document)."""
    data = LOWER[data]
    start, end, counts = words(data, off)
    h, n = shingles(spans(prefix(data), start, end), counts, k)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n))


def set_hashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64-bit hash of each document's set."""
    ends = np.concatenate([[0], np.cumsum(n)])
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h), out=sums[1:])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) + n.astype(np.uint64) * _U(0x9E6C63D0876A9A35))


def _profiles(docs: DataFrame, k: int) -> DataFrame:
    """(id, t, n, s): text hash, size and set hash of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, data, off in sliced(rb.column(1)):
                h, n = shingle_sets(data, off, k)
                yield pa.RecordBatch.from_arrays([rb.column(0).slice(a, b - a), rb.column(2).slice(a, b - a), pa.array(n.astype(np.int64)),
                                                  pa.array(set_hashes(h, n).view(np.int64))], ["id", "t", "n", "s"])

    return docs.select("id", "text", "t").mapInArrow(run, "id long, t long, n long, s long")


def _leading(docs: DataFrame, common: np.ndarray, k: int) -> DataFrame:
    """(h, n, s): the leading shingles of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON_MOST hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = shared.value
        for rb in batches:
            for a, b, data, off in sliced(rb.column(1)):
                h, n = shingle_sets(data, off, k)
                s = set_hashes(h, n).view(np.int64)
                doc = np.repeat(np.arange(b - a), n)
                order = np.arange(len(h))
                if len(late):
                    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                    order = np.lexsort((h, late[at] == h, doc))
                place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                first = place < np.repeat(n // 4 + n // EXTRA + 1, n)
                yield pa.RecordBatch.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(n[doc[first]].astype(np.int64)),
                                                  pa.array(s[doc[first]])], ["h", "n", "s"])

    return docs.select("id", "text").mapInArrow(run, "h long, n long, s long")


def _common(docs: DataFrame, rows: int, k: int) -> np.ndarray:
    """Sorted hashes of shingles in ``COMMON`` or more documents of a sample."""
    part = docs if rows <= SAMPLE else docs.filter(F.pmod(F.xxhash64("id", "t"), F.lit(-(-rows // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for _, _, data, off in sliced(rb.column(1)):
                u, c = np.unique(shingle_sets(data, off, k)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c)], ["h", "c"])

    top = (part.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= COMMON)
           .orderBy(F.desc("c"), "h").limit(COMMON_MOST).select("h").toArrow())
    return np.sort(top["h"].to_numpy().view(np.uint64))


def _meetings(leading: DataFrame) -> DataFrame:
    """Classes that meet at a leading shingle: (a, b, c, n) - pairs, how often
    they met and the smaller size - where up to ``FEW`` do, else (shingle, class,
    -1, size) for every class."""
    rows = leading.repartition(F.col("h")).sortWithinPartitions("h", "n", "s")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b", "c", "n"]

        def pairs(h, n, s) -> pa.RecordBatch:
            out = [np.zeros((3, 0), np.int64)]
            for d in range(1, FEW):
                at = np.flatnonzero((h[d:] == h[:-d]) & (NUM * n[d:] <= DEN * n[:-d]))
                out.append(np.stack([s[at], s[at + d], n[at]]))
            a, b, least = np.concatenate(out, 1)
            a, b = np.minimum(a, b), np.maximum(a, b)
            _, first, count = np.unique(mix(a.view(np.uint64)) * _U(3) + mix(b.view(np.uint64)), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[first], b[first], count, least[first])], names)

        def crowd(h, n, s) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(s), pa.array(np.full(len(h), -1)), pa.array(n)], names)

        held, large = [np.zeros(0, np.int64)] * 3, None  # the last group's rows, or its last row once it is known to be large
        for rb in batches:
            h, n, s = (np.append(x, rb.column(i).to_numpy()) for i, x in enumerate(held))
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            h, n, s = h[new], n[new], s[new]  # copies are one class
            if not len(h):
                continue
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            size = np.repeat(np.diff(np.append(start, len(h))), np.diff(np.append(start, len(h))))
            many = size > FEW
            if large is not None:
                many |= h == large
            last = h == h[-1]
            go_on = last & ~many
            if many.any():
                # the row held back from a large group has been told already
                tell = many.copy()
                if large is not None and h[0] == large:
                    tell[0] = False
                yield crowd(h[tell], n[tell], s[tell])
            small = ~many & ~go_on
            if small.any():
                yield pairs(h[small], n[small], s[small])
            if many[-1]:
                large, held = h[-1], [h[-1:], n[-1:], s[-1:]]
            else:
                large, held = None, [h[go_on], n[go_on], s[go_on]]
        if large is None and len(held[0]):
            yield pairs(*held)

    return rows.select("h", "n", "s").mapInArrow(run, "a long, b long, c long, n long")


def _candidates(meet: DataFrame) -> DataFrame:
    """Links (a, b). Sets that link meet at c shingles or more (c for the
    smaller one). Classes that meet many at fewer than c/2 of their shingles
    can only link where they also met c/2 times as a counted pair; the others
    are joined, shingle by shingle, to their neighbours by size among such."""
    counted = (meet.filter("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("n").alias("n"))
               .filter(2 * F.col("c") > F.floor(F.col("n") / EXTRA)).select("a", "b"))
    crowds = meet.filter("c < 0").select(F.col("a").alias("h"), F.col("b").alias("s"), "n")
    often = (crowds.groupBy("s").agg(F.count(F.lit(1)).alias("l"), F.min("n").alias("m"))
             .filter(2 * F.col("l") > F.floor(F.col("m") / EXTRA)).select("s"))
    rows = crowds.join(often, "s").select("h", "n", "s").repartition(F.col("h")).sortWithinPartitions("h", "n", "s")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        for rb in batches:
            h, n, s = (np.append(x, rb.column(i).to_numpy()) for i, x in enumerate(last))
            at = np.flatnonzero((h[1:] == h[:-1]) & (s[1:] != s[:-1]) & (NUM * n[1:] <= DEN * n[:-1]))
            pair = np.unique(np.stack([np.minimum(s[at], s[at + 1]), np.maximum(s[at], s[at + 1])], 1), axis=0)
            last = [h[-1:], n[-1:], s[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return counted.unionAll(rows.mapInArrow(chain, "a long, b long")).distinct()


class Forest:
    """Labels of merged sets, flat after every batch of links."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Merge; returns the links that joined two components."""
        made, root = [], {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for i, j in zip(a.tolist(), b.tolist()):
            x, y = find(int(self.label[i])), find(int(self.label[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                made.append((i, j))
        if made:
            to = np.arange(len(self.label))
            for x in root:
                to[x] = find(x)
            self.label = to[self.label]
        return made


class Block:
    """The sets of one block (sorted shingles, concatenated) and their tree."""

    def __init__(self, tokens: list[np.ndarray]):
        order = sorted(range(len(tokens)), key=lambda i: (int(tokens[i][0]), len(tokens[i])))
        self.order, self.sets = order, [tokens[i] for i in order]
        self.size = np.array([len(t) for t in self.sets], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.concatenate(self.sets)
        bits = 1 << int(np.clip(2 * int(np.median(self.size)), 64, 4096) - 1).bit_length()
        self.bitmap = self._bitmaps(bits)
        self.hidden = self.size - np.bitwise_count(self.bitmap).sum(1)
        self.forest, self.links = Forest(len(self.sets)), []

    def _bitmaps(self, bits: int) -> np.ndarray:
        out = np.zeros((len(self.sets), bits // 64), np.uint64)
        at = mix(self.flat) & _U(bits - 1)
        who = np.repeat(np.arange(len(self.sets)), self.size)
        np.bitwise_or.at(out.reshape(-1), who * (bits // 64) + (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        return out

    def _verify(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link the pairs whose shingles reach the similarity; pairs already in
        one component are passed over."""
        for lo in range(0, len(a), 256):
            x, y = a[lo:lo + 256], b[lo:lo + 256]
            open_ = self.forest.label[x] != self.forest.label[y]
            x, y = x[open_], y[open_]
            ok = np.zeros(len(x), bool)
            for j, (p, q) in enumerate(zip(x.tolist(), y.tolist())):
                small, large = (self.sets[p], self.sets[q]) if self.size[p] <= self.size[q] else (self.sets[q], self.sets[p])
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                both = int((large[at] == small).sum())
                ok[j] = DEN * both >= NUM * (len(small) + len(large) - both)
            if ok.any():
                self.links += self.forest.link(x[ok], y[ok])

    def hubs(self, most: int = 24) -> None:
        """A set against all of the block, as long as that settles many."""
        n = len(self.sets)
        while most > 0:
            most -= 1
            label, count = np.unique(self.forest.label, return_counts=True)
            alone = label[count == 1]
            if len(alone) < max(LEAF, n // 100):
                return
            hub = int(alone[np.argsort(self.size[alone], kind="stable")[len(alone) // 2]])
            mine = self.sets[hub]
            at = np.searchsorted(mine, self.flat)
            at[at == len(mine)] = 0
            seen = np.concatenate([[0], np.cumsum(mine[at] == self.flat)])
            both = seen[self.ends[1:]] - seen[self.ends[:-1]]
            ok = DEN * both >= NUM * (self.size + len(mine) - both)
            ok[hub] = False
            near = np.flatnonzero(ok)
            self.links += self.forest.link(np.full(len(near), hub), near)
            if len(near) < n // 100:
                return

    def _tree(self) -> list[tuple]:
        """Levels from the sets up: (first set of each node..., bitmaps, least
        and largest size, hidden tokens)."""
        n = len(self.sets)
        levels = [(np.arange(n + 1), self.bitmap, self.size, self.size, self.hidden)]
        step = LEAF
        while True:
            _, bm, lo, hi, hid = levels[-1]
            at = np.arange(0, len(bm), step)
            first = np.append(levels[-1][0][at], n)
            levels.append((first, np.bitwise_or.reduceat(bm, at, axis=0), np.minimum.reduceat(lo, at),
                           np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)))
            if len(at) == 1:
                return levels
            step = FAN

    def _uniform(self, first: np.ndarray) -> np.ndarray:
        """The one component of each node's sets, or -1."""
        lab = self.forest.label
        lo, hi = np.minimum.reduceat(lab, first[:-1]), np.maximum.reduceat(lab, first[:-1])
        return np.where(lo == hi, lo, -1)

    def _possible(self, level: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether members of the nodes a and b may link, by the bound."""
        first, bm, lo, hi, hid = level
        whole = self._uniform(first)
        keep = (whole[a] < 0) | (whole[a] != whole[b])
        keep &= (NUM * lo[a] <= DEN * hi[b]) & (NUM * lo[b] <= DEN * hi[a])
        at = np.flatnonzero(keep)
        for i in range(0, len(at), 8192):
            x, y = a[at[i:i + 8192]], b[at[i:i + 8192]]
            share = np.bitwise_count(bm[x] & bm[y]).sum(1, dtype=np.int64) + np.minimum(hid[x], hid[y])
            share = np.minimum(share, np.minimum(hi[x], hi[y]))
            keep[at[i:i + 8192]] = (NUM + DEN) * share >= NUM * (lo[x] + lo[y])
        return keep

    def traverse(self) -> None:
        """Dual traversal from (root, root); a stack of node pairs per level
        keeps the frontier small."""
        levels = self._tree()
        stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            lv, a, b = stack.pop()
            if len(a) > 512 and lv:
                stack.append((lv, a[512:], b[512:]))
                a, b = a[:512], b[:512]
            keep = self._possible(levels[lv], a, b)
            if lv == 0:
                keep &= a != b
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if lv == 0:
                self._verify(a, b)
                continue
            step = LEAF if lv == 1 else FAN
            below = len(levels[lv - 1][1])
            x = (a[:, None] * step + np.arange(step)).repeat(step, 1).ravel()
            y = np.tile(b[:, None] * step + np.arange(step), (1, step)).ravel()
            ok = (x < below) & (y < below) & (x <= y)
            stack.append((lv - 1, x[ok], y[ok]))

    def run(self) -> list[tuple[int, int]]:
        """Links that span the block's components, as places in the input."""
        if len(self.sets) > 2 * LEAF:
            self.hubs()
        self.traverse()
        return [(self.order[i], self.order[j]) for i, j in self.links]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, t): a document is named by id and text hash, so null ids, or one
    id on many texts, do not meet one another."""
    text = F.col(text_col).cast("string")
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))


def _bitmap(keys: DataFrame, bits: int = BITMAP) -> np.ndarray:
    """Bitmap of fixed size (so at most ``bits / 64`` rows are collected) of the
    hashes of (id, t); it passes every key, and others at the rate it is filled."""
    spot = F.pmod(F.xxhash64("id", "t"), F.lit(bits))
    one = F.expr("shiftleft(1L, cast(spot % 64 as int))")
    got = (keys.select(spot.alias("spot")).select(F.floor(F.col("spot") / 64).cast("int").alias("w"), one.alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _in_bitmap(df: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """The documents (id, text, t) that the bitmap passes. Of a document that stands
    often a task passes about one copy: what it passed last is remembered by ``SENT`` places."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP bits, 1 MB
    bits, names = len(bitmap) * 64, df.columns
    spotted = df.withColumn("_spot", F.xxhash64("id", "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(SENT, np.int64)
        for rb in batches:
            whole = rb.column(rb.num_columns - 1).to_numpy()
            spot = whole % bits
            at = np.flatnonzero((shared.value[spot >> 6] >> (spot & 63)) & 1 == 1)
            at = at[sent[whole[at] % SENT] != whole[at]]
            at = np.sort(at[np.unique(whole[at], return_index=True)[1]])
            sent[whole[at] % SENT] = whole[at]
            yield rb.take(pa.array(at)).select(names)

    return spotted.mapInArrow(run, df.schema)


def _block_links(rows: DataFrame, k: int) -> DataFrame:
    """(a, b) links that span the components of every block (or pair of pages),
    from the texts of its classes, by block and class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None

        def done() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            name = list(held)
            return [(name[i], name[j]) for i, j in Block(list(held.values())).run()]

        def batch(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

        for rb in batches:
            out = []
            cols = list(zip(*[c.to_pylist() for c in rb.columns[:4]]))
            for a, b, data, off in sliced(rb.column(4)):
                h, n = shingle_sets(data, off, k)
                ends, own = np.concatenate([[0], np.cumsum(n)]), set_hashes(h, n).view(np.int64)
                for i in range(a, b):
                    if cols[i][:3] != key:
                        out += done()
                        held, key = {}, cols[i][:3]
                    if own[i - a] == cols[i][3]:  # an id may stand on several texts
                        held[cols[i][3]] = h[ends[i - a]:ends[i - a + 1]]
            if out:
                yield batch(out)
        if out := done():
            yield batch(out)

    return rows.select("block", "p", "q", "s", "text").mapInArrow(run, "a long, b long")


def _groups(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, t, n, s, root, component_id), one row per input row."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/sigtree-{uuid.uuid4().hex}"
    docs = keyed(df, id_col, text_col)
    common = _common(docs, docs.count(), k)
    made = _profiles(docs, k)
    made.write.parquet(f"{base}/profiles")
    profiles = spark.read.schema(made.schema).parquet(f"{base}/profiles")

    meet = _meetings(_leading(docs, common, k))
    meet.write.parquet(f"{base}/meetings")
    blocks = components(_candidates(spark.read.schema(meet.schema).parquet(f"{base}/meetings")))
    known = F.nullif(F.col("id"), F.lit(NO_ID))
    classes = (profiles.filter("n > 0").groupBy("s").agg(F.max("n").alias("n"), F.min(known).alias("least"), F.min(F.struct("id", "t")).alias("one"))
               .select("s", "n", "least", "one.id", "one.t"))
    wanted = blocks.join(classes, blocks["node"] == classes["s"]).select(F.col("root").alias("block"), "s", "n", "least", "id", "t").checkpoint()
    per = wanted.groupBy("block").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("tokens"))
    pages = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("tokens") / BLOCK_TOKENS))
    # pairs of pages hold two pages, so a page is half a block
    big = per.withColumn("pages", F.when(pages > 1, pages * 2).otherwise(1).cast("long")).filter("pages > 1").select("block", "pages")

    texts = _in_bitmap(docs, _bitmap(wanted.select("id", "t")))
    found = texts.join(wanted.select("id", "t", "block", "s"), ["id", "t"]).select("block", "s", "text")
    rows = found.join(big, "block", "left")
    page = F.pmod(F.xxhash64("s"), F.coalesce("pages", F.lit(1)))
    others = F.when(F.col("pages").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1), lambda x: x != F.col("page")))
    rows = (rows.withColumn("page", page).withColumn("other", F.explode(others))
            .select("block", F.least("page", "other").alias("p"), F.greatest("page", "other").alias("q"), "s", "text")
            .repartition("block", "p", "q").sortWithinPartitions("block", "p", "q", "s"))
    links = components(_block_links(rows, k))

    # smallest id of each component of classes, then of each class, then per document
    joined = classes.join(links, classes["s"] == links["node"], "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    lows = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(lows, "root").select("s", "root", "component_id")
    full = profiles.filter("n > 0").select("id", "t", "n", "s").join(named, "s").select("id", "t", "n", "s", "root", "component_id")
    empty = profiles.filter("n = 0").select("id", "t", "n", "s", F.lit(None).cast("long").alias("root"), known.alias("component_id"))
    return full.unionByName(empty)


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_class), one row per input row."""
    return _groups(df, id_col, text_col, k).select(F.nullif(F.col("id"), F.lit(NO_ID)).alias("doc_id"), F.col("n").alias("n_shingles"),
                                                   "component_id", F.col("s").alias("set_class"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with one row of each group, that of the smallest id (null last, then
    by text hash); same columns. Rows without words stay. Where one id stands on
    several texts each is a document of its own; of equal rows one stays."""
    groups = _groups(df, id_col, text_col, K).checkpoint()
    late = F.when(F.col("id") == NO_ID, 1).otherwise(0)
    first = groups.filter("root is not null").groupBy("root").agg(F.min(F.struct(late.alias("late"), "id", "t")).alias("m")).select("root", "m.id", "m.t")
    rows = groups.filter("root is not null").groupBy("id", "t", "root").agg(F.count(F.lit(1)).alias("rows"))
    stays = rows.join(first, ["root", "id", "t"], "left_semi")
    gone = rows.join(first, ["root", "id", "t"], "left_anti").select(F.col("id").alias("__gone_id"), F.col("t").alias("__gone_t"))
    again = stays.filter("rows > 1").select(F.col("id").alias("__gone_id"), F.col("t").alias("__gone_t")).checkpoint()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = df.withColumn("__id", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))).withColumn("__t", F.xxhash64(text))

    def on(keys: DataFrame):
        return (marked["__id"] == keys["__gone_id"]) & (marked["__t"] == keys["__gone_t"])

    out = marked.join(gone, on(gone), "left_anti")
    if not again.isEmpty():
        # repeated rows: one of each, combined before the shuffle
        single = marked.join(again, on(again), "left_anti").join(gone, on(gone), "left_anti")
        out = single.unionByName(marked.join(again, on(again), "left_semi").dropDuplicates(["__id", "__t"]))
    return out.select(*df.columns)
