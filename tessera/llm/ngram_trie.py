"""Language-model scoring with Elias-Fano n-gram tries.

The model is a bigram model with Dirichlet smoothing over a smoothed unigram
model: p(w|v) = (c(vw) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 1/2) / (N + (V+1)/2),
all counts from the training documents. Seen pairs store log10 p(w|v), words
their log10 p(w) and the back-off log10 MU / (c(v) + MU), each as two bytes on one
scale of ``STEPS`` steps that N and V fix, so equal texts score alike in any block and
any file layout.

Counts are global, but no task needs all of them. Documents are read into blocks
of about ``BLOCK_BYTES``; a block sends its distinct words, and then its distinct
pairs, as sorted hash lists to ``shards`` (ranges of the hash), which add up all
blocks' training counts and answer each block with the totals for what it sent.
What is gathered grows with the corpus, in proportion; nothing is broadcast but
N and V. From the answers a block builds the slice of the trie its documents can
ask for: per level a monotone Elias-Fano sequence (a word's successors are stored
relative to its context, as context * words + successor) with Elias-Fano
pointers from each context to its successors, in flat buffers that may be
memory-mapped. Every pair is looked up by successor search inside the range of
its context.

Frequent words and pairs cost a shard one entry per block, however hot they are.
Nulls are empty texts (one end token); a null id is a training document; repeated
rows count as often as they stand there; extra columns are ignored; an empty
table gives an empty result. Blocks and answers are written to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import LOWER, mix, prefix, sliced, spans, words
from tessera.session import ensure_checkpoint_dir

BLOCK_BYTES = 8 << 20
SHARDS = 64
MOST_SHARDS = 4096
MU = 2000.0
STEPS = 1 << 16
_U = np.uint64
END = _U(0x1D8E4E27C47D124F)    # the end token's hash
BEGIN = _U(0xEB44ACCAB455D165)  # the context of a document's first token


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unsqueeze(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def squeeze_sorted(x: np.ndarray) -> bytes:
    return squeeze(np.diff(x, prepend=_U(0)))


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(b, np.uint64), dtype=np.uint64)


class EliasFano:
    """A monotone sequence below ``limit``: low bits packed flat, high bits as
    one bit per element and bucket. All buffers are flat arrays."""

    def __init__(self, values: np.ndarray, limit: int):
        n = max(len(values), 1)
        self.n = len(values)
        self.low_bits = max(0, (max(int(limit), 1) // n).bit_length() - 1)
        kind = np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        v = values.astype(np.uint64)
        self.low = (v & _U((1 << self.low_bits) - 1)).astype(kind)
        high = (v >> _U(self.low_bits)).astype(np.int64)
        buckets = (int(limit) >> self.low_bits) + 2
        bit = np.zeros(self.n + buckets, np.uint8)
        bit[high + np.arange(self.n)] = 1
        self.high = np.packbits(bit)
        self.length = len(bit)

    def _directory(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each element's bit, elements before each bucket)."""
        if not hasattr(self, "_dir"):
            bit = np.unpackbits(self.high, count=self.length)
            ones, zeros = np.flatnonzero(bit), np.flatnonzero(bit == 0)
            self._dir = ones, np.concatenate([[0], zeros - np.arange(len(zeros))])
        return self._dir

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at the given places."""
        ones, _ = self._directory()
        return ((ones[i] - i).astype(np.int64) << self.low_bits) | self.low[i].astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element >= x (n if none): the bucket by the high
        bits, then halving on its low bits."""
        _, before = self._directory()
        bucket = np.minimum(x >> self.low_bits, len(before) - 2)
        lo, hi = before[bucket].copy(), before[bucket + 1].copy()
        want = (x & ((1 << self.low_bits) - 1)).astype(np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            less = np.zeros(len(x), bool)
            less[open_] = self.low[mid[open_]].astype(np.int64) < want[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)


class Quantised:
    """Log probabilities as two bytes each, the nearest of ``STEPS`` equal steps from
    ``least`` to 0. The scale is the same for all blocks, so a value's code is, too."""

    def __init__(self, values: np.ndarray, least: float):
        self.least, self.step = least, -least / (STEPS - 1)
        self.code = np.clip(np.rint((values - least) / self.step), 0, STEPS - 1).astype(np.uint16)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.least + self.code[i] * self.step


class Trie:
    """Two levels: words 0..m-1 (m is the begin context) and pairs of them."""

    def __init__(self, word_count: np.ndarray, begin_count: int, first: np.ndarray, second: np.ndarray, pair_count: np.ndarray,
                 total: int, distinct: int, mu: float = MU):
        m = len(word_count)
        self.m = m
        unigram = np.log10((word_count + 0.5) / (total + 0.5 * (distinct + 1)))
        context = np.append(word_count, begin_count)
        least = float(np.log10(0.5 / (total + 0.5 * (distinct + 1) + mu)))  # no probability is lower
        self.unigram, self.backoff = Quantised(unigram, least), Quantised(np.log10(mu / (context + mu)), least)
        seen = pair_count > 0
        key = first[seen] * m + second[seen]
        order = np.argsort(key)
        f, s, c = first[seen][order], second[seen][order], pair_count[seen][order]
        self.pairs = EliasFano(key[order], (m + 1) * m)
        self.pointer = EliasFano(np.searchsorted(f, np.arange(m + 2)), len(f) + 1)
        self.pair = Quantised(np.log10((c + mu * 10 ** unigram[s]) / (context[f] + mu)), least)

    def score(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """log10 p(second | first)."""
        out = self.backoff[first] + self.unigram[second]
        if self.pairs.n:
            lo, hi = self.pointer.get(first), self.pointer.get(first + 1)
            key = first * self.m + second
            at = self.pairs.successor(key)
            ok = (at >= lo) & (at < hi)
            ok[ok] = self.pairs.get(at[ok]) == key[ok]
            out[ok] = self.pair[at[ok]]
        return out


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per block: ids, tokens per document, held-out flags, the sorted
    hashes of its words, and the tokens as places in that list (the most
    frequent words numbered first, for the compressor)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for rb in batches:
            for a, b, data, off in sliced(rb.column(2), BLOCK_BYTES):
                low = LOWER[data]
                hashes, counts = [], []
                for lo, hi, part, part_off in sliced(pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), b - a, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(low)])):
                    start, end, n = words(part, part_off)
                    h = spans(prefix(part), start, end)
                    hashes.append(np.insert(h, np.cumsum(n), END))
                    counts.append(n + 1)
                vocab, tok = np.unique(np.concatenate(hashes), return_inverse=True)
                rank = np.argsort(np.argsort(-np.bincount(tok, minlength=len(vocab)), kind="stable"), kind="stable")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([rb.column(0).slice(a, b - a).to_pylist()], pa.list_(pa.int64())),
                     pa.array([rb.column(1).slice(a, b - a).to_pylist()], pa.list_(pa.bool_())),
                     pa.array([np.concatenate(counts).tolist()], pa.list_(pa.int64())),
                     pa.array([squeeze_sorted(vocab)], pa.binary()), pa.array([squeeze(rank[tok].astype(np.uint32))], pa.binary()),
                     pa.array([squeeze(rank.astype(np.uint32))], pa.binary())],
                    ["block", "ids", "held", "lens", "vocab", "tokens", "rank"])
                number += 1

    return docs.mapInArrow(run, "block long, ids array<long>, held array<boolean>, lens array<long>, vocab binary, tokens binary, rank binary")


class _Block:
    """A decoded row: words, tokens, and the distinct pairs of neighbours."""

    def __init__(self, row: dict):
        self.vocab = unsqueeze_sorted(row["vocab"])
        rank = unsqueeze(row["rank"], np.uint32)
        word = np.empty(len(rank), np.int64)
        word[rank] = np.arange(len(rank))
        self.tok = word[unsqueeze(row["tokens"], np.uint32)]
        self.lens = np.array(row["lens"], np.int64)
        self.held = np.array([bool(x) for x in row["held"]])
        self.train = np.repeat(~self.held, self.lens)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tok[self.train], minlength=len(self.vocab))

    def pairs(self) -> None:
        begin = np.cumsum(self.lens) - self.lens
        self.prev = np.empty(len(self.tok), np.int64)
        self.prev[1:] = self.tok[:-1]
        self.prev[begin] = len(self.vocab)
        left = np.append(self.vocab, BEGIN)
        h = mix(mix(left[self.prev] + _U(1)) * _U(3) + self.vocab[self.tok])
        self.pair, self.first, self.back = np.unique(h, return_index=True, return_inverse=True)

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.back[self.train], minlength=len(self.pair))


def _packets(blocks: DataFrame, shards: int, pairs: bool) -> DataFrame:
    """(shard, block, hashes, counts): a block's distinct words or pairs by
    hash range, with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for row in rb.to_pylist():
                b = _Block(row)
                if pairs:
                    b.pairs()
                hashes, counts = (b.pair, b.pair_counts()) if pairs else (b.vocab, b.word_counts())
                cut = np.searchsorted(hashes, _edges(shards))
                rows = [(s, row["block"], squeeze_sorted(hashes[x:y]), squeeze(counts[x:y].astype(np.uint32)))
                        for s, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int64(), pa.binary(), pa.binary()])],
                                                 ["shard", "block", "hashes", "counts"])

    return blocks.mapInArrow(run, "shard int, block long, hashes binary, counts binary")


def _edges(shards: int) -> np.ndarray:
    return np.array([(i << 64) // shards for i in range(shards)] + [(1 << 64) - 1], np.uint64)


def _answers(packets: DataFrame) -> DataFrame:
    """(block, shard, totals, seen): the global training counts of what a block
    asked for, and - once per shard - how many of its entries have any."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("block")
        hashes = [unsqueeze_sorted(x.as_py()) for x in t["hashes"]]
        counts = [unsqueeze(x.as_py(), np.uint32) for x in t["counts"]]
        every, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(every), np.uint64)
        np.add.at(total, at, np.concatenate(counts).astype(np.uint64))  # whole numbers: no sum is rounded or cut
        ends = np.cumsum([0] + [len(h) for h in hashes])
        seen = [int((total > 0).sum())] + [0] * (len(hashes) - 1)
        return pa.table([t["block"], t["shard"], pa.array([squeeze(total[at[a:b]]) for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                         pa.array(seen, pa.int64())], ["block", "shard", "totals", "seen"])

    return packets.groupBy("shard").applyInArrow(run, "block long, shard int, totals binary, seen long")


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = df.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{base}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{base}/{name}")

    blocks = stored(_blocks(docs), "blocks")
    shards = max(SHARDS, min(MOST_SHARDS, 2 * blocks.count()))
    sums = blocks.select(F.explode(F.arrays_zip("held", "lens")).alias("z")).filter("not z.held").agg(
        F.sum("z.lens").alias("n"), F.count(F.lit(1)).alias("d")).first()
    total, begins = int(sums["n"] or 0), int(sums["d"])
    word = stored(_answers(_packets(blocks, shards, False)), "words")
    pair = stored(_answers(_packets(blocks, shards, True)), "pairs")
    distinct = int(word.agg(F.sum("seen")).first()[0] or 0)
    answers = (word.withColumn("level", F.lit(1)).unionAll(pair.withColumn("level", F.lit(2)))
               .groupBy("block").agg(F.collect_list(F.struct("level", "shard", "totals")).alias("answers")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for i in range(rb.num_rows):
                row = rb.slice(i, 1).to_pylist()[0]
                b = _Block(row)
                b.pairs()
                got = sorted(row["answers"], key=lambda x: (x["level"], x["shard"]))
                counts = [np.concatenate([unsqueeze(x["totals"], np.uint64) for x in got if x["level"] == lv]).astype(np.int64) for lv in (1, 2)]
                trie = Trie(counts[0], begins, b.prev[b.first], b.tok[b.first], counts[1], total, distinct, mu)
                each = trie.score(b.prev[b.first], b.tok[b.first])[b.back]
                own = counts[0][b.tok]
                plain = np.log10((own + 0.5) / (total + 0.5 * (distinct + 1)))
                begin = np.cumsum(b.lens) - b.lens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(b.held), pa.array(b.lens),
                     pa.array(np.add.reduceat((own > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), total)),
                     pa.array(np.add.reduceat(plain, begin)), pa.array(np.add.reduceat(each, begin))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return blocks.join(answers, "block").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
