"""Phrase counts from graph flow, collocations and unary paths against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from tessera.llm import debruijn

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, h long, k int, a long, n long, rank int"


def pieces(text):
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER))]


def plain_counts(rows):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        for w in pieces(text):
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain_collocations(rows, least, top=2000):
    f, n = plain_counts(rows)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        heavy = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    heavy[p[i:i + k]] = max(heavy[p[i:i + k]], a)
        rank = []
        for p, a in cand.items():
            if p in heavy and 100 * heavy[p] >= 80 * a:
                continue
            score, _, l, r = min(((2_000_000 * a) // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus(rng, n):
    pool = [rng.choice(["Ab", "cé", "漢", "d-e", "f\x1c", "G", "hh'"]) + str(i) for i in range(40)]
    for i in range(n):
        words = [rng.choice(pool[:1 + int(rng.random() ** 2 * 40)]) + rng.choice([""] * 9 + [".", ",", "\n", " \t", "\x0b"]) for _ in range(rng.randint(1, 60))]
        if i % 4 == 0:
            words[3:3] = "the quick Brown fox jumps over a lazy dog tonight".split()
        yield rng.choice([" ", "  ", " \t"]).join(words), rng.choice(["en", "en", "de", None, "und"])


def test_flows_equal_counted_phrases():
    rng = random.Random(1)
    texts = [t for t, _ in corpus(rng, 60)] + ["", " ", "...", "one", "a b. c"]
    raw = [t.translate(LOWER).encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    start, end, doc, left = debruijn.tokens(data, off)
    grams = debruijn.hashes(debruijn.word_hashes(data, start, end, np.zeros(len(start), np.uint64)))
    for k, (key, count) in enumerate(debruijn.flows(grams, left), 1):
        want, _, _ = debruijn.sums(grams[k - 1][left >= k], np.ones(int((left >= k).sum()), np.int64))
        assert (key == want).all() and (count == np.unique(grams[k - 1][left >= k], return_counts=True)[1]).all()
    got = [data[a:b].tobytes().decode() for a, b in zip(start, end)]
    assert got == [w for t in texts for p in pieces(t) for w in p]


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 500, "shard_bytes": 300}])
def test_collocations_against_plain_counting(spark, monkeypatch, sizes):
    rng = random.Random(6)
    rows = list(corpus(rng, 400)) + [(None, "en"), ("", None), ("x", "de")] + [("hot pair " * 300, "en"), ("same row here. ", "fr")] + [("same row here. ", "fr")] * 80
    if sizes:
        monkeypatch.setattr(debruijn, "MOST_BITS", 256)  # a full bitmap only sends more
    df = spark.createDataFrame([(i, *r, 1, 2, 3, 4, 5) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    for least, top in ((8, 2000), (3, 25)):
        out = debruijn.collocations(df, min_count=least, top=top, **sizes)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = plain_collocations(rows, least, top)
        assert len(want) > 25 and sorted(map(tuple, out.collect())) == want


def test_paths_join_unary_edges(spark):
    rows = [("we saw the quick brown fox jumps over a lazy dog again", "en")] * 5 + [("we saw the other one", "en")] * 7 + [("the quick brown fox sat here", "en")] * 5
    nodes, _ = debruijn.graph(spark.createDataFrame(rows, "text string, lang string"), min_count=3)
    got = {(r.phrase, r.a) for r in debruijn.paths(nodes).collect()}
    assert got == plain_paths(rows, 3) and ("quick brown fox jumps over a lazy dog again", 5) in got


def plain_paths(rows, least):
    f, _ = plain_counts(rows)
    out = set()
    for c in f.values():
        edges = {p: a for p, a in c.items() if len(p) == 4 and a >= least}
        after = {p: next((q for q in edges if q[:3] == p[1:] and edges[q] == a == c[p[1:]]), None) for p, a in edges.items()}
        for p in set(edges) - set(after.values()):
            words, q = list(p), p
            while after[q]:
                q = after[q]
                words.append(q[-1])
            out.add((" ".join(words), edges[p]))
    return out


def test_long_texts_nulls_and_empty_table(spark):
    rng = random.Random(7)
    rows = [(" ".join(f"w{rng.randint(0, 300)}" for _ in range(400_000)), None), (None, None), ("z" * 1_000_000, "en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, debruijn.collocations(df).collect())) == plain_collocations(rows, 30)
    assert debruijn.collocations(df.limit(0)).count() == 0
    assert debruijn.collocations(df.limit(0).unionAll(df.filter("text is null"))).count() == 0


def test_phrases_whose_block_has_changed_are_found(spark):
    """The look-up in all blocks names the same phrases as the one by owning block."""
    rows = list(corpus(random.Random(12), 200))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    nodes, _ = debruijn.graph(df, min_count=4, block_bytes=2000)
    want = {(r.h, r.lang, r.phrase) for r in nodes.collect()}
    docs = df.selectExpr("coalesce(lang, 'und') lang", "xxhash64(coalesce(lang, 'und')) salt", "text")
    got = {tuple(r) for r in debruijn._phrases(docs, nodes.selectExpr("h own"), 2000, False).collect()}
    assert len(want) > 100 and want <= got
