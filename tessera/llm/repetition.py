"""Quality rules from suffix-array repetition.

The words of each document get a suffix array by prefix doubling (only
suffixes still tied are sorted again). Longest common prefixes of neighbours
come from the ranks kept of each doubling. A suffix's widest LCP interval
gives the longest substring that starts there and occurs twice or more; the
union of those of ``min_words`` or more words is the covered part. A document
is kept while the covered fraction and the longest repeat stay under limits.

All documents of a slice share one array; ranks hold the document, so no match
crosses documents. Map-only, memory bounded by the slice (or by one longer
document). Null and empty texts have no words; equal rows get equal verdicts;
extra columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import per_doc, prefix, sliced, spans, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
MIN_WORDS = 5
MAX_COVER = 0.30
MAX_REPEAT = 150


def suffix_ranks(ids: np.ndarray, doc: np.ndarray, limit: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of the concatenated documents and the rank arrays of word
    lengths 1, 2, 4, ...: ranks are equal where the first so many words are.
    Stops when no two suffixes tie, or at length ``limit``."""
    n = len(ids)
    _, first = np.unique(ids, return_inverse=True)
    key = doc.astype(np.int64) * (n + 1) + first
    sa = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    levels: list[np.ndarray] = []
    part, base = sa, np.zeros(n, np.int64)  # suffixes still in play, and the first place of each one's old group
    place = np.arange(n)
    key, size = key[sa], 1
    while True:
        new = np.ones(len(part), bool)
        new[1:] = (key[1:] != key[:-1]) | (base[1:] != base[:-1])
        head = np.maximum.accumulate(np.where(new, np.arange(len(part)), 0))
        rank = rank.copy()
        rank[part] = place[head]
        levels.append(rank)
        tied = ~new
        tied[:-1] |= ~new[1:]
        if not tied.any() or (limit and size >= limit):
            return sa, levels
        part, place, base = part[tied], place[tied], place[head][tied]
        after = part + size
        inside = after < n
        inside[inside] = doc[after[inside]] == doc[part[inside]]
        key = np.zeros(len(part), np.int64)
        key[inside] = rank[after[inside]] + 1
        order = np.argsort(base * (n + 2) + key, kind="stable")
        part, key = part[order], key[order]
        sa[place] = part
        size *= 2


def neighbour_lcp(sa: np.ndarray, levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Common prefix length (words) of suffixes ``sa[at - 1]`` and ``sa[at]``."""
    n = len(sa)
    a, b = sa[at - 1].copy(), sa[at].copy()
    out = np.zeros(len(at), np.int64)
    for lv in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[lv][a[ok]] == levels[lv][b[ok]]
        step = ok.astype(np.int64) << lv
        a, b, out = a + step, b + step, out + step
    return out


def repeats(ids: np.ndarray, counts: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: words in repeated ``WINDOW``-word windows, words covered
    by repeats of ``min_words`` or more, and the longest repeat (all exact)."""
    docs, n = len(counts), len(ids)
    doc = np.repeat(np.arange(docs), counts)
    zero = np.zeros(docs, np.int64)
    if not n:
        return zero, zero.copy(), zero.copy()
    sa, levels = suffix_ranks(ids, doc)
    # neighbours that share the largest power of two up to min_words are worth a look
    lv = min(len(levels) - 1, min(min_words, WINDOW).bit_length() - 1)
    at = np.flatnonzero(levels[lv][sa[1:]] == levels[lv][sa[:-1]]) + 1
    lcp = neighbour_lcp(sa, levels, at)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, sa[at], lcp)
    np.maximum.at(best, sa[at - 1], lcp)
    longest = zero.copy()
    np.maximum.at(longest, doc, np.where(best >= min_words, best, 0))

    def covered(length: int, reach: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(reach >= length)
        step = np.zeros(n + 1, np.int64)
        np.add.at(step, hit, 1)
        np.add.at(step, hit + reach[hit], -1)
        return np.bincount(doc, weights=np.cumsum(step[:n]) > 0, minlength=docs).astype(np.int64)

    windows = covered(WINDOW, np.where(best >= WINDOW, best, 0))
    return windows, covered(min_words, best), longest


def measures(data: np.ndarray, off: np.ndarray, min_words: int = MIN_WORDS) -> list[np.ndarray]:
    """All measures of the documents of one slice, in the report's order."""
    start, end, counts = words(data, off)
    sums = prefix(data)
    docs = len(counts)
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])
    w_doc = np.repeat(np.arange(docs), counts)
    word_chars = np.bincount(w_doc, weights=chars[end] - chars[start], minlength=docs).astype(np.int64)
    # lines: the text cut at each \n, as raw bytes
    nl = np.flatnonzero(data == 10)
    l_start = np.unique(np.concatenate([off[:-1], nl + 1]))
    l_doc = np.searchsorted(off[1:], l_start, "right")
    l_doc = np.minimum(l_doc, docs - 1)
    keep = l_start < off[l_doc + 1] if docs else np.zeros(0, bool)
    l_start, l_doc = l_start[keep], l_doc[keep]
    stop = np.append(nl, len(data))
    l_end = np.minimum(stop[np.searchsorted(nl, l_start)], off[l_doc + 1])
    with_word = np.searchsorted(start, l_end) > np.searchsorted(start, l_start)
    l_start, l_end, l_doc = l_start[with_word], l_end[with_word], l_doc[with_word]
    pair = np.stack([l_doc.astype(np.uint64), spans(sums, l_start, l_end)], 1)
    distinct = np.unique(pair, axis=0)[:, 0].astype(np.int64) if len(pair) else np.zeros(0, np.int64)
    dup_lines = np.bincount(l_doc, minlength=docs) - np.bincount(distinct, minlength=docs)
    windows, cover, longest = repeats(spans(sums, start, end), counts, min_words)
    return [counts, word_chars, per_doc(SYMBOLS[data], off), dup_lines, windows, cover, longest]


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                  max_cover: float = MAX_COVER, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per input row: base measures, base verdict, covered words,
    longest repeat and the method's verdict."""
    id_type = df.schema[id_col].dataType.simpleString()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
             "covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, data, off in sliced(rb.column(1)):
                n, chars, sym, dup, rep, cover, longest = measures(data, off, min_words)
                failed = (n < 20) | (100 * rep > 30 * n)
                kept = ~failed & (cover <= max_cover * n) & (longest <= max_repeat)
                cols = [pa.array(x.astype(np.int64)) for x in (n, chars, sym, dup, rep)]
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0).slice(a, b - a), *cols, pa.array(failed), pa.array(kept),
                     pa.array(cover), pa.array(longest)], names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
             "base_failed boolean, kept boolean, covered_words long, longest_repeat long")
