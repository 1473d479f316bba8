"""Document fingerprints by locally consistent parsing.

A text is a string of symbols (code points at level 0). Each level merges runs
of one symbol, then tosses deterministic coins: a symbol's label is the place
and value of the lowest bit in which it differs from its left neighbour, and
three more rounds on the labels leave six values in which neighbours still
differ. Phrases begin at local maxima of the labels, so where they begin
depends on a few neighbouring symbols only. A phrase is named by a hash of its
symbols, and the names are the next level's string. Equal substrings therefore
get equal phrase names everywhere but near their ends, whatever their offset.

A fingerprint holds the root (the level at which one name is left: equal for
equal texts alone), the number of phrases of levels 1 to 3 (about 3, 10 and 30
characters), and a 64-bin minimum sketch of the names of level 3; texts with
few phrases at a level carry the sketch of the level below as well. The
likeness of two fingerprints estimates the share of names in common, at the
highest level on which either has ``ENOUGH`` phrases.

All documents of a slice are parsed at once as NumPy arrays; memory is bounded
by the slice. Null is the empty text; its fingerprint is that of no phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import mix

BINS = 64
LEVELS = 3
ENOUGH = 16
SLICE_CHARS = 1 << 18
_U = np.uint64
_EMPTY = 0xFFFFFFFF


def _toss_table(bits: int) -> np.ndarray:
    """label(own, left) for values of ``bits`` bits: 2 * place + bit of the
    lowest differing place; equal values give 0."""
    own, left = np.divmod(np.arange(1 << (2 * bits)), 1 << bits)
    diff = own ^ left
    place = np.bitwise_count((diff & -diff) - 1)
    return np.where(diff == 0, 0, 2 * place + ((own >> place) & 1)).astype(np.uint8)


_TOSS = {b: _toss_table(b) for b in (7, 4, 3)}


def _left(x: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Left neighbours; 0 at the documents' first symbols."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[edge] = 0
    return out


def _merge_runs(sym: np.ndarray, doc0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol inside a document become one symbol; ``doc0`` are
    the documents' offsets into ``sym``."""
    new = np.ones(len(sym), bool)
    np.not_equal(sym[1:], sym[:-1], out=new[1:])
    new[doc0[:-1][doc0[:-1] < len(sym)]] = True
    if new.all():
        return sym, doc0
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(sym)))
    out = sym[at].astype(np.uint64)
    long = run > 1
    out[long] = mix(out[long] * _U(3) + run[long].astype(np.uint64) * _U(0x9FB21C651E98DF25))
    return out, np.searchsorted(at, doc0)


def _phrases(sym: np.ndarray, doc0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: the phrase names and the documents' offsets into them."""
    sym, doc0 = _merge_runs(sym, doc0)
    n = len(sym)
    edge = doc0[:-1][doc0[:-1] < doc0[1:]]
    diff = sym ^ _left(sym, edge)
    place = np.bitwise_count((diff & (~diff + diff.dtype.type(1))) - diff.dtype.type(1))
    lab = (2 * place + ((sym >> place.astype(sym.dtype)) & sym.dtype.type(1)).astype(np.uint8)) & 127
    for bits in (7, 4, 3):
        lab = _TOSS[bits][(lab.astype(np.uint16) << bits) | _left(lab, edge)]
    right = np.zeros_like(lab)
    right[:-1] = lab[1:]
    right[edge[1:] - 1] = 0
    start = (lab > _left(lab, edge)) & (lab >= right)
    # the first phrase has two symbols or more, so every level is shorter
    start[edge[edge + 1 < n] + 1] = False
    start[edge] = True
    at = np.flatnonzero(start)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    hashed = mix(sym.astype(np.uint64) + _U(0x632BE59BD9B4E019)) * (place.astype(np.uint64) * _U(2) + _U(1))
    names = mix(np.add.reduceat(hashed, at) + size.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)
    return names, np.searchsorted(at, doc0)


def _sketch(names: np.ndarray, doc0: np.ndarray) -> np.ndarray:
    """(documents, BINS) smallest 32-bit name value per bin."""
    docs = len(doc0) - 1
    out = np.full(docs * BINS, _EMPTY, np.uint32)
    if len(names):
        h = mix(names ^ _U(0xC2B2AE3D27D4EB4F))
        cell = np.repeat(np.arange(docs, dtype=np.uint64) * _U(BINS), np.diff(doc0)) + (h >> _U(58))
        both = np.sort((cell << _U(32)) | (h & _U(0xFFFFFFFE)))
        cell = (both >> _U(32)).astype(np.int64)
        first = np.ones(len(both), bool)
        first[1:] = cell[1:] != cell[:-1]
        out[cell[first]] = (both[first] & _U(0xFFFFFFFF)).astype(np.uint32)
    return out.reshape(docs, BINS)


def parse(texts: list[str]) -> list[tuple]:
    """(root, phrase counts by level, sketch by level) of each text."""
    doc0 = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    sym = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)
    counts, sketches, level = [], [], 0
    root = np.zeros(len(texts), np.uint64)
    while True:
        if level:
            k = np.diff(doc0)
            one = k == 1
            root[one & (root == 0)] = sym[doc0[:-1][one & (root == 0)]]
            if level <= LEVELS:
                counts.append(k)
                sketches.append(_sketch(sym, doc0))
            elif (root != 0)[k > 0].all():
                break
        if len(sym) == 0 and level >= LEVELS:
            break
        sym, doc0 = _phrases(sym, doc0)
        level += 1
    counts, sizes = np.array(counts), [len(t) for t in texts]
    # the size tells a run from its symbol and the empty text from all others
    root = mix(root + np.array(sizes, np.uint64))
    return [(int(root[i]), tuple(int(c) for c in counts[:, i]), [s[i] for s in sketches]) for i in range(len(texts))]


def _level(a: tuple, b: tuple) -> int:
    """Highest level on which either text has enough phrases."""
    for lv in range(LEVELS - 1, 0, -1):
        if max(a[1][lv], b[1][lv]) >= ENOUGH:
            return lv
    return 0


def likeness(a: tuple, b: tuple) -> float:
    """Estimated share of common phrase names, 0 to 1; 1 for equal texts."""
    if a[0] == b[0]:
        return 1.0
    lv = _level(a, b)
    x, y = a[2][lv], b[2][lv]
    used = int(((x != _EMPTY) | (y != _EMPTY)).sum())
    return float(((x == y) & (x != _EMPTY)).sum() / used) if used else 0.0


def as_string(fp: tuple) -> str:
    """root:counts:sketches, from level 3 down to the first with enough phrases."""
    parts = []
    for lv in range(LEVELS - 1, -1, -1):
        parts.append(fp[2][lv].astype(">u4").tobytes().hex())
        if fp[1][lv] >= ENOUGH:
            break
    return f"{fp[0]:016x}:{'.'.join(map(str, fp[1]))}:{'.'.join(parts)}"


def parse_all(texts: list[str]) -> list[tuple]:
    """``parse`` in slices of bounded size."""
    out, a = [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= SLICE_CHARS):
            size += len(texts[b])
            b += 1
        out += parse(texts[a:b])
        a = b
    return out


def fingerprints(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with a ``fingerprint`` column (map-only)."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            fps = parse_all([t or "" for t in rb.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(map(as_string, fps), pa.string())],
                                             [*rb.schema.names, "fingerprint"])

    return df.mapInArrow(run, df.withColumn("fingerprint", F.lit("")).schema)


RANGE_BYTES = 8 << 20
ROW_BYTES = 1024  # what a row counts besides its text
MAX_RANGES = 4096
DRAWS = 64


def _bounds(keyed: DataFrame) -> list[tuple[int, int, int]]:
    """First keys of the ranges, in order, from sampled rows; the first is the
    first key of all. Ranges are about equal in bytes."""
    size = F.octet_length("text") + ROW_BYTES
    total, first = keyed.agg(F.sum(size), F.min(F.struct("z", "a", "h"))).first()
    ranges = min(MAX_RANGES, (total or 0) // RANGE_BYTES)
    if ranges < 2:
        return []
    step = total / (ranges * DRAWS)  # a row larger than a step is surely drawn, and counts by its size
    drawn = keyed.filter(F.rand(7) * F.lit(step) < size).select("z", "a", "h", F.greatest(size / F.lit(step), F.lit(1.0))).collect()
    out, held = [tuple(first)], 0.0
    for z, a, h, weight in sorted(map(tuple, drawn)):
        if held >= DRAWS and (z, a, h) > out[-1]:
            out.append((z, a, h))
            held = 0.0
        held += weight
    return out[:MAX_RANGES]


def edit_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text beside its edited text and its next document, in descending
    id order (null ids last, ties by the text's hash, then by text; after the
    last comes the first).

    The edited text is the text with its last floor(n/3) code points replaced
    by the first as many (or all) of the next document's.

    Rows are dealt once, by ranges of (id, text hash) whose bounds are rows of
    the table; the row at a bound is also sent to the range before, so each range,
    read in order, has every row's next one beside it and holds two texts at a
    time. The bounds are at most ``MAX_RANGES`` keys of whole numbers. Rows with
    the same id and the same text share a range. Fingerprints of equal
    neighbours are computed once."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = src.select("doc_id", "text", F.col("doc_id").isNull().cast("int").alias("z"),
                       F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("a"), F.xxhash64("text").alias("h"))
    bounds = _bounds(keyed)
    alone = len(bounds) < 2
    if alone:
        dealt = keyed.withColumn("copy", F.lit(0)).repartition(1)
    else:
        key = F.struct("z", "a", "h")
        lit = F.array(*[F.struct(F.lit(z).alias("z"), F.lit(a).cast("long").alias("a"), F.lit(h).cast("long").alias("h")) for z, a, h in bounds])
        own = keyed.withColumn("range", F.size(F.filter(lit, lambda b: b <= key)) - 1).withColumn("copy", F.lit(0))
        # the first row of a range also follows the last one of the range before; that of the first follows the very last
        to = spark.createDataFrame([(*b, (i - 1) % len(bounds)) for i, b in enumerate(bounds)], "z int, a long, h long, range int")
        heads = (keyed.join(F.broadcast(to), ["z", "a", "h"]).groupBy("z", "a", "h", "range").agg(F.min("text").alias("text"))
                 .select(F.lit(None).cast("long").alias("doc_id"), "text", "z", "a", "h", "range", F.lit(1).alias("copy")))
        dealt = own.unionByName(heads).repartitionById(len(bounds), F.col("range"))
    dealt = dealt.sortWithinPartitions("copy", "z", "a", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None      # (id, text, fingerprint) still waiting for its next row
        opening = None   # the first row, which follows the last one if there is one range only
        closed = False

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in NAMES]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)

        def pairs(rows: list[tuple]) -> list[tuple]:
            """rows: (id, text, fingerprint) in order, each but the last with its next beside it."""
            edits, out = [], []
            for (_, t, _), (_, nxt, _) in zip(rows, rows[1:]):
                k = len(t) // 3
                edits.append(t[:len(t) - k] + nxt[:k])
            once = list(dict.fromkeys(edits))
            known = dict(zip(once, parse_all(once)))
            for (i, t, fp), (_, _, nf), e, ef in zip(rows, rows[1:], edits, (known[e] for e in edits)):
                out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_string(fp), as_string(ef),
                            likeness(fp, ef), likeness(fp, nf)))
            return out

        def fresh(ids: list, texts: list[str]) -> list[tuple]:
            once = list(dict.fromkeys(texts))
            known = dict(zip(once, parse_all(once)))
            return [(i, t, known[t]) for i, t in zip(ids, texts)]

        for rb in batches:
            for lo in range(0, rb.num_rows, 512):
                part = rb.slice(lo, 512)
                copy = part.column(2).to_pylist()
                rows = fresh(part.column(0).to_pylist(), part.column(1).to_pylist())
                own = [r for r, c in zip(rows, copy) if c == 0]
                if own:
                    opening = opening or own[0]
                    line = ([held] if held else []) + own
                    held = line[-1]
                    yield emit(pairs(line))
                if len(own) < len(rows) and held and not closed:
                    yield emit(pairs([held, rows[len(own)]]))
                    closed = True
        if held and not closed and alone:
            yield emit(pairs([held, opening]))

    return dealt.select("doc_id", "text", "copy").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
