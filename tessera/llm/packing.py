"""Mixture-controlled packing by deficit round-robin.

Tokens are cut into windows of ``WINDOW`` ids. Each source has a queue and a
deficit counter: every window adds ``WINDOW * share`` to each counter, serves
each queue the whole tokens it is owed, and carries the fractions on. With
integer weights the counters have a closed form - after w windows the first i
queues together have served floor(w * WINDOW * weight of those / all weight)
tokens - so the carry crosses windows and partitions without any state: where
a token lands follows from its place in its queue alone. When a queue cannot
fill its part of another window, the shares of the rest are set anew (a phase).
Default weights are the sources' own tokens, so that all queues end together.

On the cluster: documents are dealt to hash slots of about ``SLOT_TOKENS``
tokens; a queue is its documents by slot, then by a hash. A document's place is
the queue's tokens in earlier slots (a prefix sum over the small table of slot
and queue totals) plus those before it in its slot. A task holds one slot;
sources, however hot, are spread over all slots. Sources with less than
``1/QUEUES`` of the tokens share one queue (those with weights of their own
another), so there are at most ``QUEUES + 2`` and the schedule is of bounded size.
A shared queue is a stream that is dealt to its sources by the same closed form,
in groups of up to ``QUEUES`` sources or groups; a source's place goes through
its groups' streams by a table joined by source. One window in all, the last,
may be short.

Token ids are written once to the shared folder, so a lost executor re-reads
them. Null and empty texts are one end id; repeated rows are packed as rows of
their own; a null source is a source; extra columns are ignored; an empty table
gives no pieces."""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.textbytes import LOWER, mix, prefix, sliced, spans, words
from tessera.plans.order import with_row_index
from tessera.session import ensure_checkpoint_dir

WINDOW = 2048
END_ID = 1
MOST_REPEATED = 100_000  # groups of equal rows that are dealt to several slots
SLOT_TOKENS = 1 << 20
QUEUES = 128
TOKENIZER = "word_bpe_49k.json"
MARK = "\x01"
TABLE_BITS = 21
TABLE_IDS = 1 << 24


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordTable:
    """Token ids of words a Python worker has met. A word has one slot, by its
    hash; a later word of the same slot takes its place, and the table starts
    anew when its ids fill ``TABLE_IDS``, so its memory is bounded. The tokenizer
    drops white space and splits at it, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.mark = self.tok.encode(MARK, add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self):
        self.key = np.zeros(1 << TABLE_BITS, np.uint64)
        self.first, self.count = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(1 << TABLE_BITS, np.int32)
        self.pool, self.used = np.empty(TABLE_IDS, np.uint16), 0

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with their end ids, number per document)."""
        start, end, counts = words(data, off)
        # the tokenizer folds case, but for special tokens, whose names hold a bar
        key = spans(prefix(LOWER[data]), start, end)
        if (data == 0x7C).any():
            bars = np.concatenate([[0], np.cumsum(data == 0x7C)])
            key = np.where(bars[end] > bars[start], mix(spans(prefix(data), start, end)), key)
        slot = (key >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        first, n = self.first[slot], self.count[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            seen, at, back = np.unique(key[miss], return_index=True, return_inverse=True)
            at, raw = miss[at], data.tobytes()
            ids, many = self._encode_words([raw[i:j].decode("utf-8", "replace")
                                            for i, j in zip(start[at].tolist(), end[at].tolist())])
            if len(ids) > len(self.pool) - self.used:
                if self.used:
                    self._clear()
                    return self.encode(data, off)
                self.pool = np.empty(len(ids), np.uint16)
            where = self.used + np.cumsum(many) - many
            self.pool[self.used:self.used + len(ids)] = ids
            self.used += len(ids)
            first[miss], n[miss] = where[back], many[back]
            # words of one slot may be written in turn: all three arrays keep the last
            self.key[slot[at]], self.first[slot[at]], self.count[slot[at]] = seen, where, many
        return self._gather(first, n, counts)

    def _encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number per word). One call on the words joined by
        a mark with an id of its own; word by word if a word holds the mark."""
        joined = np.array(self.tok.encode_batch_fast([f" {MARK} ".join(new)], add_special_tokens=False)[0].ids, np.uint16)
        cut = np.flatnonzero(joined == self.mark)
        if len(cut) == len(new) - 1:
            ends = np.append(cut, len(joined))
            begins = np.concatenate([[0], cut + 1])
            return np.delete(joined, cut), (ends - begins).astype(np.int64)
        lists = [e.ids for e in self.tok.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([t for x in lists for t in x], np.uint16), np.array([len(x) for x in lists], np.int64)

    def _gather(self, first: np.ndarray, n: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs = len(counts)
        word_end = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        doc_end = word_end[np.cumsum(counts)]
        total = np.diff(np.concatenate([[0], doc_end])) + 1
        ids = np.full(word_end[-1] + docs, END_ID, np.uint16)
        place = np.ones(len(ids), bool)
        place[np.cumsum(total) - 1] = False
        ids[place] = self.pool[np.arange(word_end[-1]) + np.repeat(first - word_end[:-1], n)]
        return ids, total


_TABLES: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The table of this Python worker, kept from task to task. Tasks get this
    function by name; a global used in their own closures would be a fresh copy."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def tokenize(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """The columns but the text, then ``n_tokens``, ``ids_hash`` (crc32 of the
    ids) and ``ids`` (little-endian, 16 bits)."""
    rest = [c for c in df.columns if c != text_col]
    src = df.select(*[F.col(f"`{c}`") for c in rest], F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for rb in batches:
            for a, b, data, off in sliced(rb.column(rb.num_columns - 1)):
                ids, total = table.encode(data, off)
                ends = np.concatenate([[0], np.cumsum(total)]).astype(np.int64) * 2
                ids = ids.astype("<u2")
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                view, cut = memoryview(ids).cast("B"), ends.tolist()
                crc = pa.array([zlib.crc32(view[i:j]) for i, j in zip(cut, cut[1:])], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(a, b - a) for c in rb.columns[:-1]], pa.array(total), crc, blob.cast(pa.binary())],
                    [*rest, "n_tokens", "ids_hash", "ids"])

    from pyspark.sql import types as T
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_hash", T.LongType()), T.StructField("ids", T.BinaryType())])
    return src.mapInArrow(run, schema)


class Lane:
    """One queue's part of a schedule: by phase the first window, the number of
    windows, the quotas of the queues before it and up to it, the whole, and
    what it had served."""

    def __init__(self, window: int, phases: list[tuple]):
        self.window, self.phases = window, phases

    def _upto(self, phase: tuple, quota: int, w: int) -> int:
        return w * quota if phase[4] is None else w * self.window * quota // phase[4]

    def _served(self, phase: tuple, w: int) -> int:
        return self._upto(phase, phase[3], w) - self._upto(phase, phase[2], w)

    def cut(self, start: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start in the document, length, window, offset) of the pieces of the
        tokens ``start .. start + n`` of the queue."""
        out, pos, end = [], start, start + n
        k = max(j for j, p in enumerate(self.phases) if p[5] <= start)
        phase = self.phases[k]
        w = self._guess(phase, pos)
        while pos < end:
            rel = pos - phase[5]
            while w >= phase[1] or rel >= self._served(phase, w + 1):
                w += 1
                if w >= phase[1]:
                    k, w = k + 1, 0
                    phase = self.phases[k]
                    rel = pos - phase[5]
            before = self._served(phase, w)
            m = min(end - pos, self._served(phase, w + 1) - rel)
            lead = self._upto(phase, phase[2], w + 1) - self._upto(phase, phase[2], w)
            out.append((pos - start, m, phase[0] + w, lead + rel - before))
            pos += m
        return out

    def _guess(self, phase: tuple, pos: int) -> int:
        """A window of the phase at or before that of the token, found by halving."""
        lo, hi, rel = 0, phase[1], pos - phase[5]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self._served(phase, mid) <= rel else (lo, mid)
        return lo


class Schedule:
    """Where each queue's tokens go. Built on the driver from at most
    ``QUEUES + 2`` totals and weights, and sent to the tasks."""

    def __init__(self, totals: list[int], weights: list[int] | None = None, window: int = WINDOW):
        self.window, self.totals = window, list(totals)
        left, at, served, self.phases = list(totals), 0, [0] * len(totals), []
        weights = list(weights or totals)
        while sum(left):
            live = [w if n else 0 for w, n in zip(weights, left)]
            if not any(live):
                live = list(left)
            while min(w for w in live if w) * window < sum(live):  # a live queue gets a token of every window at least
                live = [max(w, sum(live) // window + 1) if w else 0 for w in live]
            whole = sum(live)
            fill = min(n * whole // (window * w) for n, w in zip(left, live) if w)
            if fill:
                quotas = [sum(live[:i + 1]) for i in range(len(live))]
            else:  # one window that empties a queue, or the short last one
                fill, whole, room, quota = 1, None, min(window, sum(left)), [0] * len(left)
                for i in sorted(range(len(left)), key=lambda i: left[i] * sum(live) - window * live[i]):
                    quota[i] = min(left[i], room, max(1, window * live[i] // sum(live)))
                    room -= quota[i]
                for i in sorted(range(len(left)), key=lambda i: quota[i] - left[i]):
                    more = min(left[i] - quota[i], room)
                    quota[i], room = quota[i] + more, room - more
                quotas = [sum(quota[:i + 1]) for i in range(len(quota))]
            self.phases.append((at, fill, quotas, whole, list(served)))
            for i in range(len(left)):
                n = self._served(self.phases[-1], i, fill)
                left[i], served[i] = left[i] - n, served[i] + n
            at += fill

    def _upto(self, phase: tuple, i: int, w: int) -> int:
        """Tokens that queues 0..i have served after w windows of the phase."""
        _, _, upto, whole, _ = phase
        if i < 0:
            return 0
        if whole is None:
            return w * upto[i]
        return w * self.window * upto[i] // whole

    def _served(self, phase: tuple, i: int, w: int) -> int:
        return self._upto(phase, i, w) - self._upto(phase, i - 1, w)

    def lane(self, i: int) -> Lane:
        """What queue i needs of the schedule."""
        return Lane(self.window, [(at, fill, upto[i - 1] if i else 0, upto[i], whole, served[i])
                                  for at, fill, upto, whole, served in self.phases])

    def cut(self, i: int, start: int, n: int) -> list[tuple[int, int, int, int]]:
        return self.lane(i).cut(start, n)


def cut_path(lanes: list[Lane], start: int, n: int) -> list[tuple[int, int, int, int]]:
    """Pieces of the tokens ``start .. start + n`` of a source, through the
    streams of its groups to the windows of the last lane."""
    parts = [(0, n, start)]
    for lane in lanes:
        out: list[tuple] = []
        for a, m, pos in parts:
            for x, k, w, o in lane.cut(pos, m):
                to = w * lane.window + o
                if out and out[-1][2] + out[-1][1] == to and (lane is not lanes[-1] or o):
                    out[-1] = (out[-1][0], out[-1][1] + k, out[-1][2])
                else:
                    out.append((a + x, k, to))
        parts = out
    return [(a, m, *divmod(to, lanes[-1].window)) for a, m, to in parts]


def tail_lanes(sources: DataFrame, total: int) -> DataFrame:
    """(queue, lanes) of the sources (queue, n, w) that share a queue: groups of
    up to ``QUEUES`` sources, in the order in which they run out and then of
    weight, each dealt to the group's stream by a schedule of its own; groups are
    grouped alike until one is left. A source has one lane a level, as bytes."""
    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by("idx")
        n, w = t["n"].to_pylist(), t["w"].to_pylist()
        least = -(-sum(w) // min((x for x in w if x), default=1))
        plan = Schedule(n, w, min(WINDOW, max(least, round(WINDOW * sum(n) / total), len(n))))
        lanes = [pickle.dumps((plan.window, plan.lane(i).phases)) for i in range(len(n))]
        return pa.table([t["id"], pa.array(lanes, pa.binary()), t["parent"].cast(pa.string())], ["id", "lane", "parent"])

    nodes, paths, left = sources.withColumnRenamed("queue", "id"), None, sources.count()
    while left:
        ends = F.when(F.col("w") > 0, F.col("n") / F.col("w")).otherwise(float("inf"))
        dealt = (with_row_index(nodes.withColumn("ends", ends), ["ends", "w", "id"], "idx")
                 .withColumn("parent", F.floor(F.col("idx") / QUEUES)))
        lane = dealt.groupBy("parent").applyInArrow(run, "id string, lane binary, parent string")
        if paths is None:
            paths = lane.select(F.col("id").alias("queue"), F.array("lane").alias("lanes"), "parent")
        else:
            paths = (paths.withColumnRenamed("parent", "id").join(lane, "id")
                     .select("queue", F.concat("lanes", F.array("lane")).alias("lanes"), "parent"))
        nodes = dealt.groupBy(F.col("parent").cast("string").alias("id")).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
        left = -(-left // QUEUES) if left > QUEUES else 0
    return paths.select("queue", "lanes")


def queue_table(per_source: DataFrame, total: int, weights: dict | None = None) -> tuple[list, Schedule, DataFrame | None]:
    """Names of the queues of one source, the schedule, and the lanes of the
    other sources (queue, lanes, top), from (queue, n). At most ``QUEUES`` rows
    can hold ``1/QUEUES`` of all tokens, so that many reach the driver. The
    queues after the named ones are the small sources without a weight of their
    own, by their tokens, and those with one."""
    spark = per_source.sparkSession
    big = sorted((r["queue"], int(r["n"])) for r in per_source.filter(F.col("n") * QUEUES >= total).collect())
    names = [q for q, _ in big]
    totals, shares = [n for _, n in big], [int((weights or {}).get(q, 0)) for q in names]
    if sum(totals) == total:
        return names, Schedule(totals, shares if weights else None), None
    small = per_source.filter(F.col("n") * QUEUES < total)
    own = [(q, int(w)) for q, w in (weights or {}).items() if q is not None]
    table = spark.createDataFrame(own, "queue string, w long")
    lanes = None
    for top, part in enumerate([small.join(table, "queue", "left_anti").withColumn("w", F.col("n")), small.join(table, "queue")], len(names)):
        row = part.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
        totals.append(int(row["n"] or 0))
        shares.append(int((weights or {}).get(None, 0)) if top == len(names) else int(row["w"] or 0))
        if totals[-1]:
            found = tail_lanes(part.select("queue", "n", "w"), total).withColumn("top", F.lit(top))
            lanes = found if lanes is None else lanes.unionAll(found)
    return names, Schedule(totals, shares if weights else None), lanes


def _slotted(tokens: DataFrame, slots: int, slot_tokens: int, total: int) -> DataFrame:
    """Hash slot of every row of the stored token table. Equal rows that fill a good
    part of a slot are dealt to several, by their place in the stored files; they are
    interchangeable, so it does not matter which copy lies where. Such groups are at
    most ``MOST_REPEATED``, which bounds their broadcast."""
    key = F.xxhash64("doc_id", "n_tokens", "ids_hash")
    limit = max(slot_tokens // 4, -(-total // MOST_REPEATED), 1)
    repeated = (tokens.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_copies"), F.max("n_tokens").alias("_n"))
                .filter(F.col("_copies") > 1).filter(F.col("_copies") * F.col("_n") > limit)
                .select("_key", F.ceil(F.col("_copies") * F.col("_n") / limit).alias("_parts")))
    place = F.xxhash64(F.substring(F.col("_metadata.file_name"), 1, 10), F.col("_metadata.row_index"))
    part = F.xxhash64("_key", F.pmod(F.col("_place"), F.col("_parts")))
    slot = F.when(F.col("_parts").isNull(), F.pmod(F.col("_key"), F.lit(slots))).otherwise(F.pmod(part, F.lit(slots)))
    columns = tokens.columns
    return (tokens.withColumn("_place", place).withColumn("_key", key).join(F.broadcast(repeated), "_key", "left")
            .select(*columns, slot.alias("slot")))


def pack(df: DataFrame, path: str | None = None, weights: dict | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source", slot_tokens: int = SLOT_TOKENS) -> DataFrame:
    """Every row's pieces. ``weights`` (source name -> integer; None for the small
    sources it does not name) are the mixture; by default each source's own tokens."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/packing-{uuid.uuid4().hex}"
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    src = df.select(F.col(id_col).alias("doc_id"), name.alias("queue"), F.col(text_col).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    tokens = tokenize(src, path or tokenizer_path())
    tokens.write.parquet(base)
    tokens = spark.read.schema(tokens.schema).parquet(base)
    total = int(tokens.agg(F.sum("n_tokens")).first()[0] or 0)
    names, plan, lanes = queue_table(tokens.groupBy("queue").agg(F.sum("n_tokens").alias("n")), total,
                                     {k if k is None else f"={k}": v for k, v in weights.items()} if weights else None)
    slots = max(1, -(-total // slot_tokens))
    number = {q: i for i, q in enumerate(names)}
    tokens = _slotted(tokens, slots, slot_tokens, total)
    earlier = Window.partitionBy("queue").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = (tokens.groupBy("slot", "queue").agg(F.sum("n_tokens").alias("n"))
              .select("slot", "queue", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("at")))

    def run(rows_of_slot: pa.Table) -> pa.Table:
        t = rows_of_slot.combine_chunks()
        at, docs = t.filter(pc.is_null(t["ids"])), t.filter(pc.is_valid(t["ids"]))
        ids, blobs = docs["doc_id"].to_pylist(), [x.as_py() for x in docs["ids"]]
        queue = docs["queue"].to_pylist()
        place = dict(zip(at["queue"].to_pylist(), at["at"].to_pylist()))
        path = {q: [*[Lane(*pickle.loads(x)) for x in few or []], plan.lane(number[q] if top is None else top)]
                for q, few, top in zip(at["queue"].to_pylist(), at["lanes"].to_pylist(), at["top"].to_pylist())}
        rows: list[tuple] = []
        for d in sorted(range(len(ids)), key=lambda i: (zlib.crc32(blobs[i], 7), ids[i] is None, ids[i] or 0)):
            wide = np.frombuffer(blobs[d], "<u2").astype("<u4")
            for a, m, w, o in cut_path(path[queue[d]], place[queue[d]], len(wide)):
                rows.append((d, a, m, zlib.crc32(wide[a:a + m].tobytes()), len(wide), w, o))
            place[queue[d]] += len(wide)
        cols = np.array(rows, np.int64).reshape(-1, 7).T
        at = pa.array(cols[0])
        return pa.table([docs["doc_id"].take(at), *[pa.array(c) for c in cols[1:]], docs["queue"].take(at)],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue"])

    # a slot's queue places and lanes ride along as rows without ids
    none = {"doc_id": id_type, "ids": "binary", "at": "long", "lanes": "array<binary>", "top": "int"}
    names_of = ["slot", "queue", *none]
    either = lambda df: df.select([F.col(c) if c in df.columns else F.lit(None).cast(none[c]).alias(c) for c in names_of])
    heads = begins if lanes is None else begins.join(lanes, "queue", "left")
    rows = either(tokens.select("slot", "queue", "doc_id", "ids")).unionAll(either(heads))
    return rows.groupBy("slot").applyInArrow(
        run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
             "offset long, source_queue string")
