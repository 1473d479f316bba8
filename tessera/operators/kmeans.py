"""k-means for many k and many starts at once, with silhouettes.

Rows are written once as packs with fixed row ids. One scan serves all starts that
have not settled: their centres are stacked into one matrix, a pack's distances to
all of them are one product, and a task sends only sums (start, centre, column). So
the scans are as many as the slowest start needs, not the sum over starts. Starts are
chosen by k-means|| (oversampling rounds whose draws are hashes of row id and start,
candidates weighted by the rows nearest to them, then k-means++ among the candidates
on the driver). Silhouettes are Spark's squared-Euclidean form: they need each
cluster's row count, sum and sum of squares only, so all k share two scans.

What is broadcast and what reaches the driver is bounded by starts x k x columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.forest import scramble
from tessera.session import ensure_checkpoint_dir

PACK_ROWS = 2_048       # a pack's distances to all centres stay near the processor; small packs spread evenly
ROUNDS = 2              # oversampling rounds of k-means||
TOL = 1e-4
_U = np.uint64


@dataclass
class Model:
    """The cheapest start of one k."""
    k: int
    centres: np.ndarray
    cost: float
    sizes: np.ndarray
    silhouette: float = 0.0


def _packs(features: DataFrame, col: str, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for rb in batches:
            for lo in range(0, rb.num_rows, PACK_ROWS):
                rows = rb.column(0).slice(lo, PACK_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([base]), pa.array([len(rows)]), pa.array([np.asarray(rows.flatten(), float).tobytes()])],
                                                 ["base", "n", "x"])
                base += len(rows)

    made = features.select(vector_to_array(col).alias("x")).filter("x is not null").mapInArrow(run, "base long, n long, x binary")
    made.write.parquet(folder)
    packs = features.sparkSession.read.schema(made.schema).parquet(folder)
    cores = features.sparkSession.sparkContext.defaultParallelism
    return packs.repartition(max(cores, packs.rdd.getNumPartitions())).persist()  # dealt in turn: every scan waits for its fullest task


def _summed(packs: DataFrame, size: int, work: Callable) -> np.ndarray:
    """Sum over packs of the arrays of ``size`` that ``work(ids, X)`` gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for rb in batches:
            for base, n, x in zip(*[c.to_pylist() for c in rb.columns]):
                total += work(np.arange(base, base + n), np.frombuffer(x).reshape(n, -1))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "v"])

    got = packs.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(size)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out


def _distances(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    return np.maximum((X * X).sum(1)[:, None] + (C * C).sum(1) - 2 * X @ C.T, 0.0)


def _nearest(X: np.ndarray, C: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """(starts, rows): the place in C of each start's nearest centre, the first of equal ones.
    A row's own square is left out; a centre's distances lie in one line."""
    D = (C * C).sum(1)[:, None] - 2 * (C @ X.T)
    at = np.repeat(edge[:-1, None], len(X), axis=1)
    for row, a, b in zip(at, edge, edge[1:]):
        low = D[a].copy()
        for j in range(a + 1, b):
            np.copyto(row, j, where=D[j] < low)
            np.minimum(low, D[j], out=low)
    return at


def _draw(ids: np.ndarray, seed: int, start: int, turn: int) -> np.ndarray:
    salt = scramble(np.array([((seed * 1009 + start) * 31 + turn + 1) & (2**64 - 1)], _U))[0]
    return (scramble(ids.astype(_U) * _U(0x9E3779B97F4A7C15) + salt) >> _U(11)) * 2.0 ** -53


def _starts(packs: DataFrame, n: int, d: int, ks: list[int], seed: int) -> list[np.ndarray]:
    """k-means|| for every start: centres (k, d); fewer where rows repeat."""
    def sampled(share: Callable) -> list[list[np.ndarray]]:
        """Rows drawn for each start by ``share(ids, X)``: (start, places, draws), the lowest draw first."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                for base, m, x in zip(*[c.to_pylist() for c in rb.columns]):
                    ids, X = np.arange(base, base + m), np.frombuffer(x).reshape(m, -1)
                    for s, at, u in share(ids, X):
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(u[at]), pa.array([X[i].tobytes() for i in at])],
                                                             ["s", "u", "x"])

        rows = packs.mapInArrow(run, "s long, u double, x binary").orderBy("s", "u").collect()  # about 2 k rows a start
        out: list[list[np.ndarray]] = [[] for _ in ks]
        for r in rows:
            out[r["s"]].append(np.frombuffer(r["x"]))
        return out

    # one row a start: of about 16 drawn for it the lowest
    def first(ids, X):
        for s in range(len(ks)):
            u = _draw(ids, seed, s, 0)
            yield s, np.flatnonzero(u < 16.0 / n), u

    got = sampled(first)
    spare = [np.frombuffer(r["x"]) for r in packs.select(F.substring("x", 1, 8 * d).alias("x")).limit(1).collect()]
    cands = [g[:1] or list(spare) for g in got]
    for turn in range(1, ROUNDS + 1):
        edge = np.cumsum([0, *map(len, cands)])
        C = np.array([c for g in cands for c in g])

        def cost(ids, X, C=C, edge=edge):
            return np.minimum.reduceat(_distances(X, C), edge[:-1], axis=1).sum(0)

        total = _summed(packs, len(ks), cost)

        def more(ids, X, C=C, edge=edge, total=total, turn=turn):
            near = np.minimum.reduceat(_distances(X, C), edge[:-1], axis=1)
            for s, k in enumerate(ks):
                if total[s] > 0:
                    u = _draw(ids, seed, s, turn)
                    yield s, np.flatnonzero(u < 2.0 * k * near[:, s] / total[s]), u

        cands = [a + b for a, b in zip(cands, sampled(more))]
    edge = np.cumsum([0, *map(len, cands)])
    C = np.array([c for g in cands for c in g])

    def weight(ids, X):
        dist, out = _distances(X, C), np.zeros(len(C))
        for a, b in zip(edge, edge[1:]):
            out[a:b] += np.bincount(dist[:, a:b].argmin(1), minlength=b - a)
        return out

    w = _summed(packs, len(C), weight)
    return [_plus_plus(C[a:b], w[a:b], k, np.random.default_rng((seed, s))) for s, (a, b, k) in enumerate(zip(edge, edge[1:], ks))]


def _plus_plus(C: np.ndarray, w: np.ndarray, k: int, rng) -> np.ndarray:
    """k-means++ among weighted candidates, then Lloyd's steps among them."""
    pick = [int(rng.choice(len(C), p=w / w.sum()))]
    while len(pick) < k:
        p = w * _distances(C, C[pick]).min(1)
        if p.sum() <= 0:
            break
        pick.append(int(rng.choice(len(C), p=p / p.sum())))
    centres = C[pick]
    for _ in range(30):
        at = _distances(C, centres).argmin(1)
        total = np.bincount(at, w, len(centres))
        new = np.stack([np.bincount(at, w * C[:, j], len(centres)) for j in range(C.shape[1])], axis=1) / np.maximum(total, 1e-300)[:, None]
        new = np.where(total[:, None] > 0, new, centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


def _lloyd(packs: DataFrame, d: int, starts: list[np.ndarray], max_iter: int) -> list[np.ndarray]:
    """All starts moved together until each has settled."""
    centres, open_ = list(starts), list(range(len(starts)))
    for _ in range(max_iter):
        if not open_:
            break
        edge = np.cumsum([0, *[len(centres[s]) for s in open_]])
        C = np.concatenate([centres[s] for s in open_])

        def sums(ids, X, C=C, edge=edge):
            hot = np.zeros((len(C), len(X)))
            hot[_nearest(X, C, edge), np.arange(len(X))] = 1.0
            return np.column_stack([hot.sum(1), hot @ X]).ravel()

        got = _summed(packs, len(C) * (d + 1), sums).reshape(len(C), d + 1)
        new = np.where(got[:, :1] > 0, got[:, 1:] / np.maximum(got[:, :1], 1), C)
        moved, still = ((new - C) ** 2).sum(1), []
        for s, a, b in zip(open_, edge, edge[1:]):
            centres[s] = new[a:b]
            if moved[a:b].max() > TOL * TOL:
                still.append(s)
        open_ = still
    return centres


def _silhouettes(packs: DataFrame, d: int, models: list[Model], n: int) -> None:
    edge = np.cumsum([0, *[len(m.centres) for m in models]])
    C = np.concatenate([m.centres for m in models])

    def stats(ids, X):
        dist, out = _distances(X, C), np.zeros((len(C), d + 2))
        norm = (X * X).sum(1)
        for a, b in zip(edge, edge[1:]):
            hot = np.zeros((len(X), b - a))
            hot[np.arange(len(X)), dist[:, a:b].argmin(1)] = 1.0
            out[a:b] = np.column_stack([hot.sum(0), hot.T @ norm, hot.T @ X])
        return out.ravel()

    S = _summed(packs, len(C) * (d + 2), stats).reshape(len(C), d + 2)
    size, square, total = S[:, 0], S[:, 1], S[:, 2:]

    def score(ids, X):
        dist, norm, out = _distances(X, C), (X * X).sum(1)[:, None], np.zeros(len(models))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = norm + square / size - 2 * X @ (total / size[:, None]).T  # mean squared distance to each cluster
        for i, (a, b) in enumerate(zip(edge, edge[1:])):
            at, row = a + dist[:, a:b].argmin(1), np.arange(len(X))
            own = mean[row, at] * size[at] / np.maximum(size[at] - 1, 1)
            rest = np.where(size[a:b] > 0, mean[:, a:b], np.inf)
            rest[row, at - a] = np.inf
            other = rest.min(1)
            s = np.where(own < other, 1 - own / np.maximum(other, 1e-300), np.where(own > other, other / np.maximum(own, 1e-300) - 1, 0.0))
            out[i] = np.where((size[at] > 1) & np.isfinite(other), s, 0.0).sum()
        return out

    for m, a, b, s in zip(models, edge, edge[1:], _summed(packs, len(models), score)):
        m.sizes, m.silhouette = size[a:b], float(s) / n


def fit_many(features: DataFrame, ks: list[int], n_init: int, seed: int, max_iter: int, col: str = "features") -> list[Model]:
    """The cheapest of ``n_init`` starts for each k, with sizes and silhouette."""
    folder = f"{ensure_checkpoint_dir(features.sparkSession)}/kmeans-{uuid.uuid4().hex}"
    packs = _packs(features, col, folder)
    try:
        head = packs.select(F.sum("n"), F.max(F.length("x") / (8 * F.col("n")))).first()
        n, d = head[0], int(head[1])
        every = [k for k in ks for _ in range(max(1, n_init))]
        centres = _lloyd(packs, d, _starts(packs, n, d, every, seed), max_iter)
        edge, C = np.cumsum([0, *map(len, centres)]), np.concatenate(centres)
        cost = _summed(packs, len(every), lambda ids, X: np.minimum.reduceat(_distances(X, C), edge[:-1], axis=1).sum(0))
        models = []
        for k in ks:
            best = min((s for s in range(len(every)) if every[s] == k), key=lambda s: cost[s])
            models.append(Model(k, centres[best], float(cost[best]), np.zeros(0)))
        _silhouettes(packs, d, models, n)
        return models
    finally:
        packs.unpersist()
