"""kNN by cells against all distances; chained regression against plain NumPy."""

import numpy as np
import pytest

from tessera.operators import impute_models


def plain_knn(X, k):
    """Filled copy; of equally near donors any may be taken, so callers avoid such ties."""
    out, d = X.copy(), X.shape[1]
    for i, j in np.argwhere(np.isnan(X)):
        dist = []
        for r in range(len(X)):
            both = ~np.isnan(X[i]) & ~np.isnan(X[r])
            if not np.isnan(X[r, j]) and both.any():
                dist.append((((X[i] - X[r])[both] ** 2).sum() * d / both.sum(), X[r, j]))
        dist.sort()
        out[i, j] = np.mean([v for _, v in dist[:k]]) if dist else np.nanmean(X[:, j])
    return out


def frame(spark, X):
    d = X.shape[1]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(X)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"c{j} double" for j in range(d))).repartition(3), [f"c{j}" for j in range(d)]


def filled(out, cols):
    return np.array([[np.nan if r[c] is None else r[c] for c in cols] for r in sorted(out.collect(), key=lambda r: r.id)])


@pytest.mark.parametrize("cell_rows", [8, 100_000])
def test_knn_equals_all_distances(spark, monkeypatch, cell_rows):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(c, 1.0, (130, 4)) * [1, 1, 10, 0.1] for c in (0, 6, 40)])
    X[rng.random(X.shape) < 0.12] = np.nan
    X[5] = X[6] = np.nan
    X[7] = [np.nan, np.nan, np.nan, 0.3]
    X = np.concatenate([X, np.repeat(X[20:21], 40, axis=0)])  # a donor that stands forty times
    monkeypatch.setattr(impute_models, "PACK_ROWS", 16)
    df, cols = frame(spark, X)
    for patterns in (64, 2):
        monkeypatch.setattr(impute_models, "MOST_PATTERNS", patterns)
        got = filled(impute_models.knn_impute(df, cols, cell_rows=cell_rows), cols)
        assert np.allclose(got, plain_knn(X, 5))


def test_knn_visits_few_cells(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(4000, 3))
    nodes = impute_models._tree(X, 64)
    leaf = impute_models._leaf(nodes, X)
    assert len(set(leaf)) == 64 and np.bincount(leaf).max() < 130
    rows = [dict(cell=c, n=int((leaf == c).sum()), low=X[leaf == c].min(0), high=X[leaf == c].max(0), has=[float((leaf == c).sum())] * 3) for c in set(leaf)]
    cells = impute_models._Cells(rows, 3)
    Q = X[:200].copy()
    Q[:, 2] = np.nan
    bound = cells.bounds(Q)
    near = cells.first(Q, bound, 5)
    assert np.mean([len(n) for n in near]) < 3
    for i in range(200):
        true = ((X - Q[i])[:, :2] ** 2).sum(1) * 3 / 2
        assert all(bound[i, cells.cell == c][0] <= true[leaf == c].min() for c in set(leaf))
    # cells below the k-th distance of the first ones: a part of all
    kth = np.array([np.sort(((X[np.isin(leaf, cells.cell[n])] - q)[:, :2] ** 2).sum(1) * 1.5)[4] for n, q in zip(near, Q)])
    assert (bound <= kth[:, None]).sum(1).mean() < 32


def _many_cells(n=20_000):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(n, 3)) * [1, 10, 1]
    X[rng.random(X.shape) < [0, 0.3, 0.999]] = np.nan
    leaf, mask, rows = impute_models._leaf(impute_models._tree(X, 700), X), np.isnan(X) @ [1, 2, 4], []
    for m in np.unique(mask):
        for at in np.unique(leaf[mask == m]):
            P = X[(mask == m) & (leaf == at)]
            side = lambda least: [None if np.isnan(c).all() else least(c) for c in P.T]  # noqa: E731, B023
            rows.append(dict(cell=len(rows), n=len(P), low=side(np.nanmin), high=side(np.nanmax), has=(~np.isnan(P)).sum(0).tolist()))
    Q = X[:500][np.isnan(X[:500]).any(1)]
    return impute_models._Cells(rows, 3), Q, rng.random(Q.shape) * 3


def test_knn_searches_boxes_of_boxes(monkeypatch):
    """Boxes under a bound are those that a look at all cells finds, yet few are looked at."""
    cells, Q, u = _many_cells()
    assert [len(level[0]) for level in cells.levels][1:] == [90, 12]
    bound, seen, plain = cells.bounds(Q), [], impute_models._Cells._bound
    monkeypatch.setattr(impute_models._Cells, "_bound", lambda self, level, x, at: seen.append(at.size) or plain(self, level, x, at))
    who, at = cells.nearest(Q, 5)
    assert len(set(zip(who, at))) == len(who)
    for i in range(len(Q)):
        assert (cells.has[at[who == i]].sum(0)[np.isnan(Q[i])] >= 5).all()   # the third column has one donor in 1,000
    assert sum(seen) < len(Q) * len(cells.cell) / 2
    may = (np.isnan(Q)[:, None] & (bound[:, :, None] <= u[:, None]) & (cells.has > 0)).any(2) & np.isfinite(bound)
    who, at = cells.within(Q, u)
    assert sorted(zip(who.tolist(), at.tolist())) == [tuple(x) for x in np.argwhere(may).tolist()]
    seen.clear()
    cells.within(Q, u / 1000)
    assert sum(seen) < len(Q) * len(cells.cell) / 2


def test_knn_through_levels_equals_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 3)) * [1, 5, 1]
    X[rng.random(X.shape) < [0.1, 0.2, 0.6]] = np.nan
    monkeypatch.setattr(impute_models, "TOP_BOXES", 4)
    monkeypatch.setattr(impute_models, "FAN", 2)
    df, cols = frame(spark, X)
    assert np.allclose(filled(impute_models.knn_impute(df, cols, cell_rows=8), cols), plain_knn(X, 5))


def test_knn_without_donors_or_gaps(spark):
    df, cols = frame(spark, np.array([[np.nan, np.nan], [np.nan, np.nan]]))
    assert np.isnan(filled(impute_models.knn_impute(df, cols), cols)).all()
    df, cols = frame(spark, np.array([[1.0, 2.0], [3.0, 4.0]]))
    assert (filled(impute_models.knn_impute(df, cols), cols) == [[1, 2], [3, 4]]).all()
    assert impute_models.knn_impute(df.limit(0), cols).count() == 0


def plain_chain(X, rounds, ridge=1e-6, tol=1e-3):
    gaps, out = np.isnan(X), np.where(np.isnan(X), np.nanmean(X, 0), X)
    scale = np.nanmax(np.abs(X))
    for _ in range(rounds):
        before = out.copy()
        for j in sorted((j for j in range(X.shape[1]) if gaps[:, j].any()), key=lambda j: gaps[:, j].sum()):
            A = np.column_stack([np.ones(len(out)), np.delete(out, j, axis=1)])
            S = A[~gaps[:, j]]
            G = S.T @ S
            beta = np.linalg.solve(G + ridge * np.trace(G) / len(G) * np.eye(len(G)), S.T @ out[~gaps[:, j], j])
            out[gaps[:, j], j] = A[gaps[:, j]] @ beta
        if np.abs(out - before).max() <= tol * scale:
            break
    return out


@pytest.mark.parametrize("rounds", [1, 4])
def test_chained_regression_columns_in_turn(spark, rounds):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(400, 4))
    X[:, 2] = X[:, 0] * 2 - X[:, 1] + rng.normal(scale=0.1, size=400)
    X[:, 3] += X[:, 2]
    X[:, 1:][rng.random((400, 3)) < [0.1, 0.3, 0.2]] = np.nan
    df, cols = frame(spark, X)
    assert np.allclose(filled(impute_models.chained_regression(df, cols, rounds=rounds, tol=0), cols), plain_chain(X, rounds, tol=0), atol=1e-8)


def test_chained_regression_wide_and_bare(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(300, 40))
    X[rng.random(X.shape) < 0.02] = np.nan
    df, cols = frame(spark, X)
    got = filled(impute_models.chained_regression(df, cols, rounds=1), cols)
    assert np.allclose(got, plain_chain(X, 1), atol=1e-8)
    df, cols = frame(spark, np.array([[1.0, np.nan], [2.0, np.nan], [np.nan, np.nan]]))
    assert filled(impute_models.chained_regression(df, cols), cols)[2, 0] == 1.5


def test_decisions_of_every_rule(spark):
    from tessera.operators import impute as imp
    df = spark.range(60000).selectExpr("id", "IF(id % 4 = 0, NULL, id * 1.0) a", "IF(id % 100 = 0, NULL, id * 2.0) b", "id * 3.0 + id % 7 c", "id * 0.5 d",
                                       "IF(id % 3 = 0, NULL, 'x') s", "IF(id % 50 = 0, NULL, 'y') m", "IF(id % 9 = 0, NULL, date'2020-01-01') t", "cast(id % 5 as string) g",
                                       "IF(id % 6 = 0, NULL, hash(id)) r")
    pick = lambda d: {r.column: r.method for r in d.collect()}
    assert pick(imp.decide_methods(df)) == {"a": "mice", "b": "median", "s": "unknown", "m": "mode", "t": "flag_only", "r": "knn"}
    assert pick(imp.decide_methods(df, knn_max_rows=50000))["r"] == "median"
    assert pick(imp.decide_methods(df, "g")) == {"a": "group_median", "b": "median", "s": "group_mode", "m": "mode", "t": "flag_only", "r": "group_median"}
    assert pick(imp.decide_methods(df.limit(1500)))["a"] == "median" and pick(imp.decide_methods(df.limit(5000), "none"))["a"] == "group_median"
    assert pick(imp.decide_methods(df.limit(12000)))["a"] == "knn"
