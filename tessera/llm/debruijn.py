"""Phrase collocations from a weighted de Bruijn graph.

Nodes are phrases of ``ORDER - 1`` words, an edge is a phrase of ``ORDER`` words
that leads from its first words to its last ones, its weight is how often it occurs.
Only edges are counted in the texts. The count of a node is the flow that leaves it
- the weights of its edges - plus a correction, the pieces that end with it; the
same step on the nodes gives the counts of phrases one word shorter, down to words.
The steps are sums, so each block of texts takes them on its own distinct edges and
sends what it found, sorted, to ranges of the hash, which add up all blocks: a phrase
costs a range one entry per block, however hot it or its first words are.

Phrases that occur ``min_count`` times or more are the candidates' graph. Their words
come from a second scan. The range that adds a phrase up names one of the blocks that
sent it; a bitmap of the hashes of (phrase, block) (16 bits for each, at most
``MOST_BITS``; when it is full more is sent and dropped by the join, never less) lets
each block send its own phrases, so a phrase is sent about once. Phrases that their
block did not send, as an input without fixed order came otherwise, are looked up in
all blocks.

A node whose heaviest edge carries its whole flow is unary and is folded into that
edge, so an unbranched path is left as its edges (``paths`` joins them into whole
phrases); a node that keeps some flow is dropped if an edge has ``KEEP`` percent of it
or more. A longer phrase than by one word need not be looked at: the one between has
its count at least. Cuts are looked up by hash in the same counts, scores are integer
divisions of decimals.

Words are compared by 64-bit hashes mixed with their language. Nulls are empty texts,
a null language is ``und``; repeated rows count as often as they stand there; extra
columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.ngram_trie import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from tessera.llm.textbytes import LOWER, mix, prefix, sliced, spans
from tessera.session import ensure_checkpoint_dir

ORDER = 4
MIN_COUNT = 30
KEEP = 80
TOP = 2000
SCALE = 2_000_000
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 8 << 20
MOST_BITS = 1 << 28     # 32 MB
PROBES = 4
_U = np.uint64
_MARK = [(0x9FB21C651E98DF25 * (j + 3)) & (2**64 - 1) | 1 for j in range(ORDER + 1)]

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, words left in the piece) of each word of lower-cased bytes."""
    solid = ~GAP[data]
    begin, last = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]  # words do not cross documents
    begin[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, "right") - 1
    broken = np.concatenate([[0], np.cumsum(BREAK[data], dtype=np.int64)])
    stop = np.ones(len(start), bool)
    stop[:-1] = (doc[1:] != doc[:-1]) | (broken[start[1:]] != broken[end[:-1]])
    stops = np.flatnonzero(stop)
    left = stops[np.searchsorted(stops, np.arange(len(start)))] - np.arange(len(start)) + 1 if len(start) else start
    return start, end, doc, left


def hashes(word: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each length k (at k - 1) the hash of the k words from each place; what
    crosses a piece's end is for the caller to leave out."""
    acc, out = np.zeros(len(word), _U), []
    for j in range(order):
        if j < len(word):
            acc[:len(word) - j] += mix(word[j:] + _U(j + 1)) * _U(_MARK[j])
        out.append(mix(acc + _U(_MARK[j] >> 1)))
    return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(spans(prefix(data), start, end) ^ salt)


def sums(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, sums of their weights, a place of each)."""
    if not len(key):
        return key, weight, np.zeros(0, np.int64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(weight[order], first), order[first]


def flows(grams: list[np.ndarray], left: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of the phrases of 1 to ``ORDER`` words: edges are counted,
    shorter phrases are the flow of the longer ones from their place, and piece ends."""
    at = np.flatnonzero(left >= len(grams))
    weight, out = np.ones(len(at), np.int64), []
    for k in range(len(grams), 0, -1):
        if k < len(grams):  # one place of each longer phrase, and the pieces that end with this one
            ends = np.flatnonzero(left == k)
            at, weight = np.concatenate([at, ends]), np.concatenate([weight, np.ones(len(ends), np.int64)])
        key, weight, place = sums(grams[k - 1][at], weight)
        at = at[place]
        out.append((key, weight))
    return out[::-1]


def _parsed(batches: Iterator[pa.RecordBatch], block_bytes: int):
    """(block, languages, bytes, start, end, document, words left, hashes) of each
    slice of (lang, salt, text); a block is about ``block_bytes`` of a task's texts."""
    block, size = TaskContext.get().partitionId() << 32, 0
    for rb in batches:
        salt = rb.column(1).to_numpy().view(_U)
        for a, b, data, off in sliced(rb.column(2)):
            data = LOWER[data]
            start, end, doc, left = tokens(data, off)
            yield block, rb.column(0).slice(a, b - a), data, start, end, doc, left, hashes(word_hashes(data, start, end, salt[a:b][doc]))
            size += len(data)
            if size >= block_bytes:
                block, size = block + 1, 0


def _counts(docs: DataFrame, shards: int, block_bytes: int) -> DataFrame:
    """Packets (shard, k, lang, n, hashes, counts) of blocks of texts; k = 0: words of a language."""
    schema = "shard int, k int, lang string, n long, block long, h binary, c binary"
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    cuts = np.array([(j << 64) // shards for j in range(1, shards)], _U)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, left, words_of, now = [], [], {}, None

        def packets() -> Iterator[pa.RecordBatch]:
            found = flows([np.concatenate(g) for g in zip(*grams)], np.concatenate(left))
            for k, (key, weight) in enumerate(found, 1):
                edge = [0, *np.searchsorted(key, cuts).tolist(), len(key)]
                rows = [(j, k, None, None, now, squeeze_sorted(key[a:b]), squeeze(weight[a:b].astype(np.uint32)))
                        for j, (a, b) in enumerate(zip(edge, edge[1:])) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for block, langs, _, _, _, doc, rest, h in _parsed(batches, block_bytes):
            if block != now and grams:
                yield from packets()
                grams, left = [], []
            now = block
            for lang, n in zip(langs.to_pylist(), np.bincount(doc, minlength=len(langs)).tolist()):
                words_of[lang] = words_of.get(lang, 0) + n
            grams.append(h)
            left.append(rest)
        if grams:
            yield from packets()
        rows = [(hash_shard(lang, shards), 0, lang, n, None, None, None) for lang, n in words_of.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, schema)


def hash_shard(lang: str, shards: int) -> int:
    return sum(lang.encode()) % shards


def _owned(key: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Hash of a phrase in a block."""
    return mix(key ^ mix(block.astype(_U) + _U(1)))


def _frequent(packets: DataFrame, shards: int, min_count: int) -> DataFrame:
    """(k, h, c, own) of the phrases with ``min_count`` or more, by range of the hash,
    and (0, lang, c), the words of each language; ``own`` names one block, drawn by
    hash, of those that sent the phrase."""
    schema = "k int, h long, lang string, c long, own long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, words_of = None, [], {}

        def done() -> pa.RecordBatch:
            every = [unsqueeze_sorted(h) for _, h, _ in held]
            block = np.repeat(np.array([b for b, _, _ in held], np.int64), [len(x) for x in every])
            key = np.concatenate(every)
            order = np.argsort(key, kind="stable")
            key, count = key[order], np.concatenate([unsqueeze(c, np.uint32).astype(np.int64) for _, _, c in held])[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            blocks = np.diff(np.append(first, len(key)))
            count = np.add.reduceat(count, first)
            ok = count >= min_count
            first, blocks, count = first[ok], blocks[ok], count[ok]
            key, n = key[first], len(first)
            own = _owned(key, block[order[first + (mix(key) % blocks.astype(_U)).astype(np.int64)]])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now[1], np.int32)), pa.array(key.view(np.int64)), pa.nulls(n, pa.string()),
                                               pa.array(count), pa.array(own.view(np.int64))], names)

        for rb in batches:
            for shard, k, lang, n, block, h, c in zip(*[c.to_pylist() for c in rb.columns]):
                if k == 0:
                    words_of[lang] = words_of.get(lang, 0) + n
                    continue
                if now != (shard, k):
                    if held:
                        yield done()
                    now, held = (shard, k), []
                held.append((block, h, c))
        if held:
            yield done()
        if words_of:
            n = len(words_of)
            yield pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(list(words_of), pa.string()),
                                              pa.array(list(words_of.values()), pa.int64()), pa.nulls(n, pa.int64())], names)

    return packets.repartition(shards, "shard").sortWithinPartitions("shard", "k").mapInArrow(run, schema)


def _shifts(bits: int) -> list[int]:
    """Each hash sets ``PROBES`` bits, at places read off from these bits of it on."""
    return [i * (64 - bits.bit_length()) // (PROBES - 1) for i in range(PROBES)]


def _bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes ``own``; at most ``bits / 64`` rows are collected."""
    spots = F.array(*[F.pmod(F.shiftrightunsigned("own", s), F.lit(bits)) for s in _shifts(bits)])
    got = (keys.select(F.explode(spots).alias("spot")).select(F.floor(F.col("spot") / 64).cast("int").alias("w"),
                                                              F.expr("shiftleft(1L, cast(spot % 64 as int))").alias("b"))
           .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _phrases(docs: DataFrame, keys: DataFrame, block_bytes: int, by_block: bool) -> DataFrame:
    """(h, lang, phrase) of the phrases ``keys`` (own), each from the block that owns
    it; without ``by_block`` (own is the phrase's hash) from every slice that holds it."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(keys, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, langs, data, start, end, doc, left, h in _parsed(batches, block_bytes):
            keep = ~GAP[data]
            keep[1:] |= keep[:-1]  # one space after each word
            at = np.concatenate([[0], np.cumsum(keep)])
            flat = np.where(GAP[data], 0x20, data)[keep].astype(np.uint8).tobytes()
            for k in range(2, ORDER + 1):
                i = np.flatnonzero(left >= k)
                own = _owned(h[k - 1][i], np.full(1, block)) if by_block else h[k - 1][i]
                for s in _shifts(bits):
                    spot = ((own >> _U(s)) & _U(bits - 1)).astype(np.int64)
                    ok = (shared.value[spot >> 6] >> (spot & 63)) & 1 == 1
                    i, own = i[ok], own[ok]
                key, first = np.unique(h[k - 1][i], return_index=True)
                i = i[first]
                if len(key):
                    texts = [flat[a:b] for a, b in zip(at[start[i]].tolist(), at[end[i + k - 1]].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), langs.take(pa.array(doc[i])), pa.array(texts, pa.binary()).cast(pa.string())],
                                                     ["h", "lang", "phrase"])

    return docs.mapInArrow(run, "h long, lang string, phrase string")


def _parts(phrases: DataFrame) -> DataFrame:
    """Adds the hashes of each cut's parts, and of the phrase without its last and without its first word."""
    schema = "h long, k int, lang string, phrase string, a long, cuts array<struct<cut:int,lh:long,rh:long>>, head long, tail long"
    kind = pa.list_(pa.struct([("cut", pa.int32()), ("lh", pa.int64()), ("rh", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            salt = rb.column(5).to_numpy().view(_U)
            for a, b, data, off in sliced(rb.column(3)):
                start, end, doc, left = tokens(data, off)
                g = [x.view(np.int64) for x in hashes(word_hashes(data, start, end, salt[a:b][doc]))]
                first = np.searchsorted(doc, np.arange(b - a))
                n = left[first]
                cut = np.arange(int((n - 1).sum())) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1) + 1
                at, length = np.repeat(first, n - 1), np.repeat(n, n - 1)
                grid = np.stack(g)
                cuts = pa.StructArray.from_arrays([pa.array(cut.astype(np.int32)), pa.array(grid[cut - 1, at]), pa.array(grid[length - cut - 1, at + cut])],
                                                  fields=list(kind.value_type))
                ends = pa.array(np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in rb.columns[:5]] + [pa.ListArray.from_arrays(ends, cuts, type=kind), pa.array(grid[n - 2, first]),
                                                                   pa.array(grid[n - 2, first + 1])],
                    ["h", "k", "lang", "phrase", "a", "cuts", "head", "tail"])

    return phrases.select("h", "k", "lang", "phrase", "a", F.xxhash64("lang")).mapInArrow(run, schema)


def graph(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES,
          shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The frequent part of the graph: (h, k, lang, phrase, a, cuts, head, tail) of the
    phrases of 2 to ``ORDER`` words, and (k, h, lang, c), all counts, k = 0 for a language's words."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/debruijn-{uuid.uuid4().hex}"
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    docs = df.select(lang.alias("lang"), F.xxhash64(lang).alias("salt"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("b")).first()["b"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    made = _frequent(_counts(docs, shards, block_bytes), shards, min_count)
    made.write.parquet(f"{base}/frequent")
    counts = spark.read.schema(made.schema).parquet(f"{base}/frequent")
    wanted = counts.filter("k > 1").select("h", "k", F.col("c").alias("a"), "own")

    def named(keys: DataFrame, by_block: bool, name: str) -> DataFrame:
        texts = _phrases(docs, keys.select("own"), block_bytes, by_block).groupBy("h").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
        got = keys.join(texts, "h").select("h", "k", "lang", "phrase", "a")
        got.write.parquet(f"{base}/{name}")
        return spark.read.schema(got.schema).parquet(f"{base}/{name}")

    known = named(wanted, True, "phrases")
    missing = wanted.join(known.select("h"), "h", "left_anti").withColumn("own", F.col("h"))
    if not missing.isEmpty():  # the input came in other blocks than before
        known = known.unionAll(named(missing, False, "late"))
    parts = _parts(known.select("h", "k", "lang", "phrase", "a"))
    parts.write.parquet(f"{base}/graph")
    return spark.read.schema(parts.schema).parquet(f"{base}/graph"), counts


def folded(nodes: DataFrame, keep: int = KEEP) -> DataFrame:
    """The phrases that neither are folded into an edge that carries their whole
    flow nor have ``keep`` percent of it in one edge."""
    edges = (nodes.filter("k > 2").select(F.explode(F.array("head", "tail")).alias("h"), "a").groupBy("h").agg(F.max("a").alias("edge")))
    big = "decimal(38,0)"
    heavy = F.col("edge").cast(big) * 100 >= F.col("a").cast(big) * keep
    unary = F.col("edge") == F.col("a")
    return nodes.join(edges, "h", "left").filter(F.col("edge").isNull() | ~(unary | heavy)).drop("edge")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, keep: int = KEEP, top: int = TOP,
                 **sizes) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    nodes, counts = graph(df, text_col, lang_col, min_count, **sizes)
    left = folded(nodes, keep).select("h", "lang", "phrase", "a", F.explode("cuts").alias("z")).select("h", "lang", "phrase", "a", "z.*")
    part = counts.filter("k > 0")
    cuts = (left.join(part.select(F.col("h").alias("lh"), F.col("c").alias("l")), "lh")
            .join(part.select(F.col("h").alias("rh"), F.col("c").alias("r")), "rh"))
    cuts = cuts.withColumn("score", F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + r)"))
    best = (cuts.groupBy("h").agg(F.min(F.struct("score", "cut", "l", "r", "a", "lang", "phrase")).alias("m")).select("m.*"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    words = counts.filter("k = 0").groupBy("lang").agg(F.sum("c").alias("n"))
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def paths(nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a): the longest phrases along unary paths, edges that follow
    one another through nodes whose whole flow they carry, joined into one. Places on
    a path are found by pointer doubling; a path never closes, as its pieces end."""
    edges = nodes.filter(F.col("k") == ORDER).select("h", "lang", "phrase", "a", "head", "tail")
    inner = nodes.filter(F.col("k") == ORDER - 1).select(F.col("h").alias("node"), F.col("a").alias("flow"))
    out = edges.select(F.col("head").alias("node"), F.col("a").alias("flow"), F.col("h").alias("next"))
    into = edges.select(F.col("tail").alias("node"), F.col("a").alias("flow"), "h")
    links = into.join(inner, ["node", "flow"]).join(out, ["node", "flow"]).select("h", "next")
    # (edge, the edge it points to, steps to there); the last edge of a path points to itself
    cur = edges.select("h").join(links, "h", "left").select("h", F.coalesce("next", "h").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("d"))
    cur, far = cur.checkpoint(), -1
    while (now := cur.agg(F.sum("d")).first()[0] or 0) != far:
        far = now
        ahead = cur.select(F.col("h").alias("last"), F.col("last").alias("to"), F.col("d").alias("e"))
        cur = cur.join(ahead, "last").select("h", F.col("to").alias("last"), (F.col("d") + F.col("e")).alias("d")).checkpoint()
    placed = edges.join(cur, "h")
    word = F.split("phrase", " ")
    return (placed.groupBy("last").agg(F.sort_array(F.collect_list(F.struct((-F.col("d")).alias("o"), word.alias("w")))).alias("z"),
                                       F.min("lang").alias("lang"), F.min("a").alias("a"))
            .select("lang", F.array_join(F.concat(F.slice(F.col("z")[0]["w"], 1, ORDER - 1), F.transform("z", lambda x: F.element_at(x["w"], -1))), " ").alias("phrase"), "a"))
