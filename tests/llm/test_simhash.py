"""SimHash fingerprints and trie joins against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, fp long, id int, key long, label string"


def plain_print(text, k=3):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    s = [" ".join(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, bits=3):
    """Root place of each fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def expected(rows):
    fps = [plain_print(t) for _, t in rows]
    distinct = sorted(set(fps))
    roots = dict(zip(distinct, plain_groups(distinct)))
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    return sorted(((i, f"{f:016x}", least.get(roots[f])) for (i, _), f in zip(rows, fps)), key=str)


def texts(rng, n):
    pool = ["".join(rng.choice("abcdeéß漢XY.") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    out = [None, "", " \t\n", "One", "one  TWO", "one\ttwo\x0bthree", "a\x1cb c d"]
    while len(out) < n:
        base = [rng.choice(pool) for _ in range(rng.randint(1, 120))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 0, 1, 4])):
            near = list(base)
            near[rng.randrange(len(near))] = "other"
            out.append("\n ".join(near))
    return out


def flipped(rng, n, centres=6, most=5):
    """Clustered fingerprints: centres with some bits flipped."""
    base = [rng.getrandbits(64) for _ in range(centres)]
    out = {rng.getrandbits(64) for _ in range(n // 10)}
    while len(out) < n:
        x = rng.choice(base)
        for b in rng.sample(range(64), rng.randint(0, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_trie_join_of_one_range_and_of_two():
    rng = random.Random(2)
    keys = flipped(rng, 500)
    a, b = simhash.TrieJoin(np.array(keys, np.uint64), np.array([[0, 500, 0, 500]])).places()
    root = list(range(500))
    for x, y in zip(a.tolist(), b.tolist()):
        root[x] = y
    assert root == plain_groups(keys)
    left, right = keys[::2], keys[1::2]
    a, b = simhash.TrieJoin(np.array(left + right, np.uint64), np.array([[0, 250, 250, 500]])).places()
    both = plain_bipartite(left, right)
    root = list(range(500))
    for x, y in zip(a.tolist(), b.tolist()):
        root[x] = y
    assert root == both


def plain_bipartite(left, right, bits=3):
    keys, root = left + right, list(range(len(left) + len(right)))
    changed = True
    pairs = [(i, len(left) + j) for i, x in enumerate(left) for j, y in enumerate(right) if (x ^ y).bit_count() <= bits]
    while changed:
        changed = False
        for i, j in pairs:
            m = min(root[i], root[j])
            if root[i] != m or root[j] != m:
                root[i] = root[j] = m
                changed = True
    assert len(keys) == len(root)
    return root


@pytest.mark.parametrize("limit", [simhash.LIMIT, 20])
def test_links_of_clustered_fingerprints(spark, monkeypatch, limit):
    """Also with units split further down, to the last bit."""
    monkeypatch.setattr(simhash, "LEAVES", 4)
    rng = random.Random(4)
    keys = flipped(rng, 900, most=4)
    signed = [k - (1 << 64) * (k >> 63) for k in keys]
    links = simhash.components(simhash.fingerprint_links(spark.createDataFrame([(k,) for k in signed], "fp long"), limit=limit)).collect()
    got = {r.node: r.root for r in links}
    sets = {}
    for k, r in zip(signed, plain_groups(keys)):
        sets.setdefault(r, set()).add(k)
    for s in sets.values():
        assert {got.get(k, k) for k in s} == {min(s)}


def test_groups_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts(rng, 260))]
    rows += [(2000 + i, rows[40][1]) for i in range(130)] + rows[20:60] + [(None, rows[9][1]), (None, "all alone here now"), (5, "one id, two texts")]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, "z") for r in rows], SCHEMA).repartition(5)
    for hot in (10_000, 20):
        out = simhash.similar_groups(df, hot_rows=hot)
        assert out.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, out.collect()), key=str) == expected(rows)


def test_null_ids_long_text_and_empty_table(spark):
    rng = random.Random(9)
    rows = [(None, t) for t in texts(rng, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.similar_groups(df).collect()), key=str) == expected(rows)
    long = " ".join(str(rng.randint(0, 9999)) for _ in range(200_000))
    rows = [("a", long), ("b", long + " end"), ("c", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: tuple(r) for r in simhash.similar_groups(df).collect()}
    assert got["b"][2] == "a" and got["c"] == ("c", f"{plain_print(rows[2][1]):016x}", "c")
    assert simhash.similar_groups(df.limit(0)).count() == 0


def test_registered_query_against_brute_force(spark):
    from tessera.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_simhash"](spark, sf).collect()), key=str) == expected(rows)
