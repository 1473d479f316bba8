"""A stored family of suffix arrays takes batches in a later session."""

from tessera.llm.suffix_levels import Family


def test_reopened_family_matches_a_later_batch(spark, tmp_path):
    base = str(tmp_path / "family")

    def batch(*pairs):
        return spark.createDataFrame(pairs, "key long, ctx long")

    first = Family(spark, base)
    assert first.add(batch((1, 10), (2, 20), (3, 30))).count() == 0
    assert {tuple(r) for r in first.add(batch((2, 21), (4, 40))).collect()} == {(2, 20, False, True, 1), (2, 21, False, True, 1)}
    again = Family.open(spark, base)
    assert again.turn == 2 and [lv for lv, _, _ in again.levels] == [lv for lv, _, _ in first.levels]
    assert {tuple(r) for r in again.add(batch((1, 10), (4, 41), (9, 90))).collect()} == {(1, 10, True, False, 2), (4, 40, False, True, 1), (4, 41, False, True, 1)}
    for i in range(6):
        again = Family.open(spark, base)
        again.add(batch((100 + i, 1)))
    assert again.turn == 9 and len(again.levels) <= 4
    assert {r.ctx for r in Family.open(spark, base).add(batch((3, 31))).collect()} == {30, 31}
