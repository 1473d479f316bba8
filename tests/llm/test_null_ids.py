"""Tables without ids, one id on many texts, and rows repeated through a third of
the table give what named rows give, in about the same time."""

import collections
import random
import time

import pytest

from tessera.llm import sigtree, suffix_levels


def texts(rng, n):
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    passage = " ".join(rng.choice(pool) for _ in range(120))
    for i in range(n // 2):
        base = [rng.choice(pool) for _ in range(150)]
        if i % 7 == 0:
            base[40:40] = passage.split()
        yield " ".join(base)
        base[rng.randrange(len(base))] = "changed"
        yield " ".join(base)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


@pytest.mark.parametrize("ids", [[None], [7], [None, 7]])
def test_removed_bytes_and_groups_without_ids(spark, ids):
    all_texts = list(texts(random.Random(3), 1200))
    named, bare = frame(spark, list(enumerate(all_texts))), frame(spark, [(ids[i % len(ids)], t) for i, t in enumerate(all_texts)])
    took = []
    for df in (named, bare):
        t0 = time.time()
        out = suffix_levels.remove_repeats(df).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        sets = sigtree.similar_groups(df).groupBy("set_class").count().collect()
        kept = sigtree.keep_one(df).count()
        took.append((collections.Counter(map(tuple, out)), collections.Counter(map(tuple, sets)), kept, time.time() - t0))
    assert took[0][:3] == took[1][:3] and took[0][2] == 600
    assert took[1][3] < 2.5 * took[0][3] + 5


def test_a_row_repeated_through_a_third_of_the_table(spark):
    some = list(texts(random.Random(4), 300))
    rows = list(enumerate(some)) + [(3, some[3])] * 150
    df = frame(spark, rows)
    got = collections.Counter((r.doc_id, r.n_removed > 0) for r in suffix_levels.remove_repeats(df).collect())
    assert got[3, True] == 151 and sum(got.values()) == 450
    assert {r.doc_id: r.component_id for r in sigtree.similar_groups(df).collect()} == {i: i - i % 2 for i in range(300)}
    assert sorted(r.doc_id for r in sigtree.keep_one(df).collect()) == list(range(0, 300, 2))


def test_keep_one_decides_by_row(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty twentyone"
    rows = [(5, base), (5, "a wholly different text that stands under the same id as the copy"), (2, base), (None, base), (None, None), (9, " "), (None, "only one of it is here now"),
            (None, "only one of it is here now")]
    got = collections.Counter((r.doc_id, r.text) for r in sigtree.keep_one(frame(spark, rows)).collect())
    assert got == collections.Counter([rows[1], rows[2], rows[4], rows[5], rows[6]])
