"""Forest importance against a plain recursive tree, and both ways of growing."""

import numpy as np
import pytest

from tessera.operators import forest, select


def plain(bins, y, w, path, take, classes, depth=None):
    """Gains by feature of a tree grown node by node."""
    gains = np.zeros(len(bins))

    def visit(rows, path, level):
        s = forest._stats(y[rows], w[rows], classes).sum(0)
        loss = forest._loss(s, classes)
        usable = np.array([[len(set(b[rows])) > 1] for b in bins])
        if not forest._impure(s, loss, classes) or not usable.any() or level == depth:
            return
        may, best = forest._drawn(np.array([path], np.uint64), usable, take)[:, 0], None
        for f in np.flatnonzero(may):
            for cut in sorted(set(bins[f][rows]))[:-1]:
                go = bins[f][rows] <= cut
                a, b = (forest._stats(y[rows[m]], w[rows[m]], classes).sum(0) for m in (go, ~go))
                gain = loss - forest._loss(a, classes) - forest._loss(b, classes)
                if best is None or gain > best[0]:
                    best = (gain, f, go)
        gains[best[1]] += max(best[0], 0)
        p = np.array([path], np.uint64)
        visit(rows[best[2]], forest._child(p, 0)[0], level + 1)
        visit(rows[~best[2]], forest._child(p, 1)[0], level + 1)

    visit(np.arange(len(y)), path, 0)
    return gains


@pytest.mark.parametrize("classes,take,depth", [(2, 2, None), (4, 1, None), (3, 3, 2), (0, 3, None), (0, 1, 3)])
def test_subtree_against_recursion(classes, take, depth):
    rng = np.random.default_rng(classes + take)
    bins = rng.integers(0, [[4], [30], [2]], (3, 300)).astype(np.uint8)
    y = rng.integers(0, classes, 300).astype(float) if classes else (bins[0] * 2 + rng.integers(0, 8, 300)).astype(float)
    w = rng.integers(1, 4, 300).astype(float)
    got, splits, levels = forest.grow(bins, y, w, np.uint64(99), take, classes, depth)
    assert np.allclose(got, plain(bins, y, w, np.uint64(99), take, classes, depth)) and splits > 0
    assert depth is None or levels <= depth


def test_large_nodes_grow_like_small_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, (2000, 3)).astype(float)
    y = ((x[:, 0] > 20) ^ (rng.random(2000) < 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), str(t)) for r, t in zip(x, y)], "a double, b double, c double, y string").coalesce(1)
    whole = forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=5)
    assert np.allclose(whole, forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=5, local_rows=300))
    assert np.allclose(forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=5, max_depth=3),
                       forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=5, max_depth=3, local_rows=300))
    assert (whole.argmax(1) == 0).all()


def test_trees_in_groups_and_in_histogram_blocks(spark, monkeypatch):
    df = spark.range(900).selectExpr("cast(id % 13 as double) a", "cast(id % 7 as double) b", "cast((id % 13) * 3 + id % 2 as double) y").coalesce(1)
    want = forest.tree_importances(df, ["a", "b"], "y", None, n_trees=4)
    monkeypatch.setattr(forest, "FRONTIER", 20)
    monkeypatch.setattr(forest, "HIST_BYTES", 30_000)
    assert np.allclose(want, forest.tree_importances(df, ["a", "b"], "y", None, n_trees=4, local_rows=100))


def test_importance_of_classes_numbers_nulls_and_empty(spark):
    df = spark.range(3000).selectExpr("cast(id % 50 as double) a", "cast(hash(id) % 97 as int) b", "if(id % 50 > 30, 'x', 'y') t",
                                      "cast((id % 50) * (id % 50) as double) r").unionAll(spark.sql("select null, 1, 'x', 2.0D"))
    imp = select.forest_importance(df, ["a", "b"], "t", n_trees=10)
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["a"] > 0.9
    assert select.forest_importance(df, ["a", "b"], "r", n_trees=5)["a"] > 0.9
    assert select.forest_importance(df.filter("a is null"), ["a", "b"], "t", n_trees=3) == {"a": 0.0, "b": 0.0}
    assert select.forest_importance(df.filter("t = 'x'"), ["a", "b"], "t", n_trees=3) == {"a": 0.0, "b": 0.0}


def test_constant_feature_in_large_nodes(spark):
    """A feature without a split gives a null gain beside others' numbers in one task."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 40, 1500)
    df = spark.createDataFrame([(1.0, float(a), 2.0, str(int((a > 20) ^ (rng.random() < 0.1)))) for a in x], "a double, b double, c double, y string").coalesce(1)
    whole = forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=3)
    assert np.allclose(whole, forest.tree_importances(df, ["a", "b", "c"], "y", ["0", "1"], n_trees=3, local_rows=200))
    assert (whole[:, [0, 2]] == 0).all() and (whole[:, 1] > 0).all()


@pytest.mark.parametrize("classes,take,depth", [(2, 3, None), (2, 10, 4), (5, 2, None)])
def test_histograms_blocks_and_levels_give_one_tree(monkeypatch, classes, take, depth):
    """Ten features (two words a row), some constant in many nodes; every way of summing gives the plain tree."""
    rng = np.random.default_rng(classes + take)
    bins = rng.integers(0, [[2], [3], [200], [1], [2], [256], [4], [2], [2], [60]], (10, 700)).astype(np.uint8)
    y, w = rng.integers(0, classes, 700).astype(float), rng.integers(1, 19, 700).astype(float)
    want = plain(bins, y, w, np.uint64(7), take, classes, depth)
    for block, dense in ((1 << 19, 1 << 10), (100, 1 << 10), (1 << 19, 4), (1, 4)):
        monkeypatch.setattr(forest, "BLOCK_ROWS", block)
        monkeypatch.setattr(forest, "DENSE_ROWS", dense)
        got, splits, levels = forest.grow(bins, y, w, np.uint64(7), take, classes, depth)
        assert np.allclose(got, want) and splits > 0 and (depth is None or levels <= depth)


def test_large_nodes_sum_only_drawn_features(spark, monkeypatch):
    """A large node's histograms are those of the features it draws, and of further ones where these are constant."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, (1500, 5)).astype(float)
    x[:, 3] = 1.0
    df = spark.createDataFrame([(*map(float, r), str(int(r[0] > 20) ^ int(t))) for r, t in zip(x, rng.random(1500) < 0.1)],
                               "a double, b double, c double, d double, e double, y string").coalesce(1)
    asked, plain_histograms = [], forest._histograms
    monkeypatch.setattr(forest, "_histograms", lambda packs, top, pairs, d, classes: asked.extend(pairs) or plain_histograms(packs, top, pairs, d, classes))
    cut = forest.tree_importances(df, list("abcde"), "y", ["0", "1"], n_trees=3, max_features=2, local_rows=400)
    assert np.allclose(cut, forest.tree_importances(df, list("abcde"), "y", ["0", "1"], n_trees=3, max_features=2))
    features = {}
    for node, f in asked:
        features.setdefault(node, []).append(f)
    assert len(asked) == len(set(asked)) and all(len(f) == 2 or 3 in f for f in features.values())


def test_draws_equal_the_searched_ones():
    rows, root = np.arange(200_000, dtype=np.int64) + (3 << 40), forest._root(42, 5)
    u = forest.scramble(rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + root) >> np.uint64(11)
    assert (forest._weights(rows, root) == np.searchsorted(forest._DRAWS, u * 2.0 ** -53, "right")).all()
