"""Orphan counts of all steps from one chain of joins, against joining step by step."""

import random

import pytest

from tessera.operators import merge


def step_by_step(spark, main, tables):
    """Rows and orphans of each step of plain left joins on lists of dicts."""
    rows, out = main, []
    for key, right in tables:
        nxt, orph = [], 0
        for r in rows:
            hits = [x for x in right if r.get(key) is not None and x[key] == r[key]]
            orph += not hits
            nxt += [{**r, **x, "_hit": True} for x in hits] or [{**r, "_hit": False}]
        share = orph / len(nxt)
        action = None if not share else "stopped" if share > merge.ORPHAN_STOP else "quarantined" if share > merge.ORPHAN_QUARANTINE else "flagged"
        out.append((orph, round(share, 4), action))
        rows = [r for r in nxt if r["_hit"] or action != "quarantined"]
    return out, len(rows)


@pytest.mark.parametrize("seed", range(4))
def test_orphans_of_every_step(spark, seed):
    rng = random.Random(seed)
    n = 3000
    main = [{"m_id": i, "a_id": rng.choice([None, *range(60)]) if rng.random() < 0.01 else rng.randrange(60)} for i in range(n)]
    a = [{"a_id": i, "b_id": rng.randrange(40)} for i in range(59 if seed % 2 else 60)]
    a += [{"a_id": rng.randrange(50), "b_id": 1}] if seed > 1 else []  # a repeated key
    b = [{"b_id": i, "c_id": i % 20} for i in range(39)]
    c = [{"c_id": i, "value": i * 2} for i in range(20 if seed else 12)]
    frames = [spark.createDataFrame([tuple(r.values()) for r in t], ", ".join(f"{k} long" for k in t[0])) for t in (main, a, b, c)]
    res = merge.merge_tables(frames[0], [("a", frames[1], "a_id"), ("b", frames[2], "b_id"), ("c", frames[3], "c_id")])
    want, rows = step_by_step(spark, main, [("a_id", a), ("b_id", b), ("c_id", c)])
    got = {step: (count, pct, action) for step, _, kind, count, pct, action in map(tuple, res.issues.collect()) if kind == "orphans"}
    assert got == {i: w for i, w in enumerate(want, 1) if w[2]}
    assert res.data.count() == rows
    assert sum(f.count() for f in res.orphans.values()) == sum(w[0] for w in want if w[2] == "quarantined")


def test_join_count_grows_with_the_tables(spark):
    main = spark.range(50).selectExpr("id AS k_id", "id AS v")
    tables = [(f"t{i}", spark.range(50).selectExpr("id AS k_id", f"id * 2 AS x{i}"), "k_id") for i in range(5)]
    steps = merge._plan(main, tables, [])
    assert [(m, w) for m, w in merge.match_vectors(main, steps)] == [((1,) * 5, [50.0] * 5)]
