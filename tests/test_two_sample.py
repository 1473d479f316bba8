"""PSI and KS read off one sorted table against NumPy."""

import numpy as np
import pytest

from tessera.functions.two_sample import two_sample
from tessera.operators import monitor


def plain(a, b, bins=10):
    edges = np.unique(np.quantile(a, np.arange(bins + 1) / bins))
    psi = 0.0
    if len(edges) > 1:
        x, y = (np.histogram(v, edges)[0] / max(len(v), 1) for v in (a, b))
        x, y = np.where(x == 0, 0.0001, x), np.where(y == 0, 0.0001, y)
        psi = ((y - x) * np.log(y / x)).sum()
    at = np.unique(np.concatenate([a, b]))
    ks = max(abs((a[:, None] <= at).mean(0) - (b[:, None] <= at).mean(0))) if len(b) else None
    return psi, ks


def test_statistics_against_numpy(spark):
    rng = np.random.default_rng(2)
    sides = []
    for shift in (0.0, 0.7):
        n = 500 if shift else 800
        x = {"a": rng.normal(shift, 1, n), "b": rng.integers(0, 4, n).astype(float), "c": np.full(n, 3.0), "d": np.round(rng.gamma(2 + shift, 2, n), 1)}
        x["a"][::7] = np.nan
        sides.append(x)
    sides[1]["d"][:] = np.nan
    frames = [spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*s.values())], "a double, b double, c double, d double").repartition(3)
              for s in sides]
    got = two_sample(*frames, ["a", "b", "c", "d"])
    for c in "abcd":
        a, b = (s[c][~np.isnan(s[c])] for s in sides)
        psi, ks = plain(a, b)
        assert (got[c].n_a, got[c].n_b) == (len(a), len(b))
        assert got[c].psi == pytest.approx(psi) and (ks is None and got[c].ks is None or got[c].ks == pytest.approx(ks))
    assert monitor.drift_check(*frames).count() == 4
    assert monitor.drift_check(frames[0].limit(0), frames[1]).count() == 0
    assert two_sample(frames[0], frames[1], []) == {}
