"""Distinct counts without row copies; rare categories without joins."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.distinct import distinct_counts
from tessera.operators import dictionary, schema, standardize, text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_counts_and_plans(spark, monkeypatch):
    df = spark.range(500).selectExpr("id % 7 AS a", "IF(id % 3 = 0, NULL, concat('x', id % 11)) AS b", "cast(id % 5 as double) * 0.0 AS z", "array(id % 2) AS arr",
                                     "concat('T', id % 4) AS t").unionAll(spark.sql("select null, null, -0.0D, null, 't1'"))
    assert distinct_counts(df, [F.col(c) for c in df.columns] + [F.lower("t")]) == [7, 11, 1, 2, 5, 4]
    assert distinct_counts(df.limit(0), [F.col("a")]) == [0] and distinct_counts(df, []) == []
    seen = []
    real = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a, **k: seen.append(real(self, *a, **k)) or seen[-1])
    for call in (lambda: schema.infer_plan(df), lambda: dictionary.feature_dictionary(df.drop("arr")), lambda: text.detect_metrics(df, ["b", "t"])):
        call()
    assert seen and not any("Expand" in plan(x) for x in seen)


@pytest.mark.parametrize("limit", [10_000, 2])
def test_collapse_rare_against_counting(spark, limit):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 40 + ["warm"] * 8 + [f"v{i}" for i in range(30)] + [None]), rng.choice(["a", "b"])) for _ in range(4000)]
    rows += [("once", None)]
    df = spark.createDataFrame(rows, "x string, y string").repartition(3)
    out, report = standardize.collapse_rare(df, ["x", "y"], 0.02, most_kept=limit)
    count = {v: sum(r[0] == v for r in rows) for v in {r[0] for r in rows}}
    want = sorted((None if x is None else x if count[x] / len(rows) > 0.02 else "Other") or "" for x, _ in rows)
    assert sorted(r.x or "" for r in out.collect()) == want
    assert {r.column: r.n_collapsed for r in report.collect()} == {"x": sum(c / len(rows) <= 0.02 for c in count.values()), "y": 1}
    if limit > 100:
        assert "Join" not in plan(out)
