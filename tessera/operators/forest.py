"""Random-forest feature importance with trees of any depth.

No tree is ever held: an importance is a sum of the gains of its splits, so a
split is forgotten once its rows are parted.

1. Features are cut into at most ``BINS`` bins (each distinct value its own, or
   quantiles) and written once, as packs of rows with fixed row ids.
2. A tree weighs each row by a Poisson(1) draw hashed from row id and tree, the
   bootstrap of unbounded tables. While a node holds more than ``local_rows``, the
   histograms of all such nodes of a level, each over the features it draws, are summed
   over the packs' tasks and give its split; the splits of these levels, at most
   ``2 n / local_rows`` a tree, are broadcast, and trees are taken in groups that keep
   them under ``FRONTIER``.
3. The rows of every smaller node go to one task as bytes - a row is shuffled once a
   tree, whatever its depth - which grows the whole subtree until nodes are pure or their
   features constant. For classes it parts a node by histograms down to ``BLOCK_ROWS``,
   then grows level by level: one sort of (node, bin, class and weight) words a level.

A node's features are drawn by a hash of its path, so both ways of growing give
the same tree and neither layout nor lost executors change it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.columns import q
from tessera.session import ensure_checkpoint_dir

BINS = 256
LOCAL_ROWS = 1 << 23        # drawn rows of a subtree's task, one byte a feature and one more
BLOCK_ROWS = 1 << 19        # rows grown level by level: they stay in a core's cache
DENSE_ROWS = 1 << 10        # rows a node from which a level counts in cells instead of sorting
FRONTIER = 100_000          # large nodes whose splits are broadcast at once
HIST_BYTES = 128 << 20      # histograms of a level that a task sums at once
PACK_BYTES = 4 << 20
_U = np.uint64
_DRAWS = np.cumsum([np.exp(-1.0) / f for f in np.cumprod([1.0, *range(1, 18)])])  # Poisson(1)
# draw by the first 16 of the 53 bits, 255 where the others decide
_SHORT = np.searchsorted(_DRAWS, np.arange((1 << 16) + 1) / (1 << 16), "right")
_SHORT = np.where(np.searchsorted(_DRAWS, np.arange(1, (1 << 16) + 1) / (1 << 16), "left") == _SHORT[:-1], _SHORT[:-1], 255).astype(np.uint8)


def scramble(x: np.ndarray) -> np.ndarray:
    """64-bit mixing of unsigned integers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _root(seed: int, tree: int) -> np.ndarray:
    return scramble(np.array([(seed * 1_000_003 + tree + 1) & (2**64 - 1)], _U))[0]


def _child(path: np.ndarray, side: int) -> np.ndarray:
    return scramble(path * _U(2) + _U(side + 1))


def _weights(rows: np.ndarray, root: np.ndarray) -> np.ndarray:
    u = scramble(rows.astype(_U) * _U(0x9E3779B97F4A7C15) + root) >> _U(11)
    out = _SHORT[(u >> _U(37)).astype(np.int64)]
    rest = np.flatnonzero(out == 255)
    out[rest] = np.searchsorted(_DRAWS, u[rest] * 2.0 ** -53, "right")
    return out


def _loss(s: np.ndarray, classes: int) -> np.ndarray:
    """Impurity times weight of nodes, from their sums on the last axis: counts
    per class, or (weight, sum, sum of squares)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            w = s.sum(-1)
            out = w - (s * s).sum(-1) / w
        else:
            w = s[..., 0]
            out = s[..., 2] - s[..., 1] ** 2 / w
    return np.where(w > 0, out, 0.0)


def _impure(s: np.ndarray, loss: np.ndarray, classes: int) -> np.ndarray:
    return (s > 0).sum(-1) > 1 if classes else loss > 1e-12 * np.maximum(s[..., 2], 1e-300)


def _stats(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y.astype(np.int64)] = w
        return out
    return np.column_stack([w, w * y, w * y * y])


def _draws(path: np.ndarray, d: int) -> np.ndarray:
    """(node, place): the features in the order in which each node draws them, by hash
    of its path; it may split on the first ones that are not constant in it."""
    order = scramble(path[:, None] ^ scramble(np.arange(1, d + 1, dtype=_U))) >> _U(1)
    return np.argsort(order, axis=1, kind="stable")


def _drawn(path: np.ndarray, usable: np.ndarray, take: int) -> np.ndarray:
    """Mask (feature, node) of the features each node may split on: ``take`` of
    those that are not constant in it, by hash of its path."""
    order = np.stack([scramble(path ^ scramble(np.array([f + 1], _U))) >> _U(1) for f in range(len(usable))])
    order[~usable] = ~_U(0)
    rank = np.argsort(np.argsort(order, axis=0, kind="stable"), axis=0, kind="stable")
    return usable & (rank < take)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of non-negative integers, by one sort of (key, place) words."""
    bits = len(key).bit_length()
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


def _code_type(classes: int):
    return np.min_scalar_type(len(_DRAWS) * classes)


def _target_type(classes: int):
    return np.min_scalar_type(classes) if classes else np.dtype(float)


def _coded(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """Class and weight of rows (drawn once at least) as one number."""
    return ((w.astype(np.int64) - 1) * classes + y.astype(np.int64)).astype(_code_type(classes))


def _gini(s: list[np.ndarray]) -> np.ndarray:
    """``_loss`` of nodes from their counts, one array a class."""
    w = sum(s)
    with np.errstate(divide="ignore", invalid="ignore"):
        return w - sum(x * x for x in s) / w


def _bins(words: np.ndarray, f: int) -> np.ndarray:
    return (words[f >> 3] >> _U((f & 7) << 3)) & _U(255)


def grow_classes(bins: np.ndarray, code: np.ndarray, path, take: int, classes: int, depth: int | None) -> tuple[np.ndarray, int, int]:
    """``grow`` for rows with a ``_coded`` class and weight."""
    d, n = bins.shape
    gain_of, splits, levels = np.zeros(d), 0, 0
    codes = (int(code.max()) // classes + 1) * classes
    weigh = np.zeros((codes, classes))
    weigh[np.arange(codes), np.arange(codes) % classes] = np.arange(codes) // classes + 1
    eights = np.zeros((-(-d // 8), n, 8), np.uint8)   # eight features of a row in a word
    for f in range(d):
        eights[f >> 3, :, f & 7] = bins[f]
    words = eights.view("<u8")[..., 0]
    todo = [(words, code, np.array([path], _U), 0)]
    del bins, eights, words
    while todo:
        words, code, path, level = todo.pop()
        total = np.bincount(code, minlength=codes) @ weigh
        if (total > 0).sum() < 2 or level == depth:
            continue
        if len(code) <= BLOCK_ROWS:
            gains, s, deep = _grow_block(words, code, path, total, d, weigh, take, None if depth is None else depth - level)
            gain_of, splits, levels = gain_of + gains, splits + s, max(levels, level + deep)
            continue
        slices, best, seen = [slice(a, a + BLOCK_ROWS) for a in range(0, len(code), BLOCK_ROWS)], None, 0
        for f in _draws(path, d)[0].tolist():
            if seen == take:
                break
            cells = sum(np.bincount((_bins(words[:, at], f) * _U(codes)).astype(np.int64) + code[at], minlength=BINS * codes) for at in slices)
            hist = cells.reshape(BINS, codes) @ weigh
            some = np.flatnonzero(hist.any(1))
            if len(some) < 2:
                continue
            seen += 1
            left = np.cumsum(hist[some[:-1]], axis=0)
            gain = _gini(list(total)) - _gini(list(left.T)) - _gini(list((total - left).T))
            at = int(np.argmax(gain))
            if best is None or (gain[at], -f) > (best[0], -best[1]):
                best = float(gain[at]), f, int(some[at])
        if best is None:
            continue
        gain, f, cut = best
        gain_of[f] += max(gain, 0.0)
        splits, levels = splits + 1, max(levels, level + 1)
        go = np.concatenate([_bins(words[:, at], f) > _U(cut) for at in slices])
        for side in (0, 1):
            at = np.flatnonzero(go if side else ~go)
            todo.append((words.take(at, axis=1), code[at], _child(path, side), level + 1))
    return gain_of, splits, levels


def _grow_block(words: np.ndarray, code: np.ndarray, paths: np.ndarray, total: np.ndarray, d: int, weigh: np.ndarray, take: int,
                depth: int | None) -> tuple[np.ndarray, int, int]:
    """``grow`` for one impure node of few rows, level by level. A level lays the rows of
    each (node, drawn feature) out as (pair, bin), sums them by counting where nodes are
    large, else by sorting, and finds the pair's best cut in running sums; a node whose
    feature is constant draws another. Rows lie node by node and are parted in order."""
    codes, classes = weigh.shape
    gain_of, splits, level = np.zeros(d), 0, 0
    code_bits = int(codes - 1).bit_length()
    # two classes' weights in a word: one sum for both, exact as an integer or as a double
    second = [weigh[:, k + 1] if k + 1 < classes else np.zeros(codes) for k in range(0, classes, 2)]
    halves = [(weigh[:, 2 * k] + s * 2.0 ** 32).astype(np.int64) for k, s in enumerate(second)]
    doubles = [weigh[:, 2 * k] + s * 2.0 ** 26 for k, s in enumerate(second)]
    code, size, total = code.astype(np.uint32), np.array([len(code)]), list(total[:, None])   # total by class: one a node
    while len(size) and (depth is None or level < depth):
        m, n = len(size), len(code)
        start, order, loss = np.cumsum(size) - size, _draws(paths, d), _gini(total)

        def bins_of(f: np.ndarray, length: np.ndarray, at: np.ndarray | None) -> np.ndarray:
            """Bins of nodes' rows (at these places, or all) in a feature of each node."""
            if len(words) == 1:
                out = words[0] if at is None else words[0][at]
            else:
                out = words.ravel()[(np.arange(n) if at is None else at) + np.repeat((f >> 3) * n, length)]
            out = out >> np.repeat(((f & 7) << 3).astype(_U), length)
            out &= _U(255)
            return out

        best, best_f, best_bin, best_left = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64), [np.zeros(m) for _ in total]
        got, place, open_ = np.zeros(m, np.int64), np.zeros(m, np.int64), np.arange(m)
        while len(open_):
            want = np.minimum(take - got[open_], d - place[open_])
            slots = [open_[want > s] for s in range(int(want.max()))]
            f = np.concatenate([order[at, place[at] + s] for s, at in enumerate(slots)])
            node = np.concatenate(slots)
            place[open_] += want
            pairs, end = len(node), np.append(0, np.cumsum(size[node]))
            dense = end[-1] >= DENSE_ROWS * pairs
            kind = np.int64 if dense else np.uint32 if pairs.bit_length() + 8 + code_bits <= 32 else np.uint64
            shift, key, own, a = 0 if dense else code_bits, np.empty(end[-1], kind), [], 0
            for at in slots:
                b, length, where = a + len(at), size[at], None
                if len(at) < m:
                    where = np.arange(end[b] - end[a]) + np.repeat(start[at] - (end[a:b] - end[a]), length)
                part = key[end[a]:end[b]]
                part[:] = bins_of(f[a:b], length, where)
                part |= np.repeat((np.arange(a, b) << 8).astype(kind), length)
                own.append(code if where is None else code[where])
                if shift:
                    part <<= kind(shift)
                    part |= own[-1]
                a = b
            if dense:
                own = np.concatenate(own)
                cells = [np.bincount(key, x[own], pairs << 8).astype(np.int64) for x in doubles]
                value = np.flatnonzero(sum(cells))
                sums = [np.cumsum((c[value] & 0x3FFFFFF) | (c[value] >> 26 << 32)) for c in cells]
            else:
                key.sort()
                value = key >> kind(shift)
                at = np.flatnonzero(np.append(value[1:] != value[:-1], True))
                value = value[at].astype(np.int64)
                key &= kind((1 << shift) - 1)
                key = key.astype(np.int64)
                sums = [np.cumsum(x[key])[at] for x in halves]
            many = np.bincount(value >> 8, minlength=pairs)   # bins of a pair; its cuts are one fewer
            last = np.cumsum(many) - 1
            inner = np.ones(len(value), bool)
            inner[last] = False
            cut, cuts = np.flatnonzero(inner), many - 1
            has = np.flatnonzero(cuts)
            if len(has):
                left = []
                for x in sums:
                    x = x[cut] - np.repeat(np.append(0, x[last[:-1]]), cuts)
                    left += [(x & 0xFFFFFFFF).astype(float), (x >> 32).astype(float)]
                left = left[:classes]
                gain = np.repeat(loss[node], cuts) - _gini(left) - _gini([np.repeat(t[node], cuts) - x for t, x in zip(total, left)])
                first = (np.cumsum(cuts) - cuts)[has]
                top = np.maximum.reduceat(gain, first)
                hit = np.flatnonzero(gain == np.repeat(top, cuts[has]))
                hit = hit[np.searchsorted(hit, first)]
                got += np.bincount(node[has], minlength=m)
                bounds = np.searchsorted(has, np.cumsum([0, *map(len, slots)]))
                for a, b in zip(bounds[:-1], bounds[1:]):   # a node stands once in a slot
                    v, h, p = top[a:b], hit[a:b], has[a:b]
                    w = node[p]
                    better = (v > best[w]) | ((v == best[w]) & (f[p] < best_f[w]))
                    w, h, p = w[better], h[better], p[better]
                    best[w], best_f[w], best_bin[w] = v[better], f[p], value[cut[h]] & 255
                    for x, y in zip(best_left, left):
                        x[w] = y[h]
            open_ = open_[(got[open_] < take) & (place[open_] < d)]
        split = np.isfinite(best)
        if not split.any():
            break
        gain_of += np.bincount(best_f[split], np.maximum(best[split], 0.0), d)
        splits, level = splits + int(split.sum()), level + 1
        right = [t - x for t, x in zip(total, best_left)]
        live = [(sum((x > 0).astype(int) for x in child) > 1) & split for child in (best_left, right)]
        side = bins_of(best_f, size, None) > np.repeat(best_bin.astype(_U), size)
        gone = np.diff(np.append(0, np.cumsum(side)[start + size - 1]))
        at = np.concatenate([np.flatnonzero(x & np.repeat(on, size)) for x, on in ((~side, live[0]), (side, live[1]))])
        words, code = words.take(at, axis=1), code[at]
        size = np.concatenate([(size - gone)[live[0]], gone[live[1]]])
        total = [np.concatenate([x[live[0]], y[live[1]]]) for x, y in zip(best_left, right)]
        paths = np.concatenate([_child(paths[on], k) for k, on in enumerate(live)])
    return gain_of, splits, level


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, path, take: int, classes: int, depth: int | None) -> tuple[np.ndarray, int, int]:
    """(gain by feature, splits, levels) of the subtree over rows of one node;
    ``bins`` is (feature, row), ``w`` the rows' weights."""
    if classes:
        return grow_classes(bins, _coded(y, w, classes), path, take, classes, depth)
    d = len(bins)
    gain_of, splits, level = np.zeros(d), 0, 0
    stats = _stats(y, w, classes)
    rows, start, paths = np.arange(len(y)), np.zeros(1, np.int64), np.array([path], _U)
    while len(rows) and (depth is None or level < depth):
        size = np.diff(np.append(start, len(rows)))
        total = np.add.reduceat(stats[rows], start, axis=0)
        loss = _loss(total, classes)
        usable = np.stack([np.minimum.reduceat(b[rows], start) < np.maximum.reduceat(b[rows], start) for b in bins])
        live = _impure(total, loss, classes) & usable.any(0)
        if not live.any():
            break
        rows, total, loss, usable, paths, size = rows[np.repeat(live, size)], total[live], loss[live], usable[:, live], paths[live], size[live]
        start = np.cumsum(size) - size
        node = np.repeat(np.arange(len(size)), size)
        may = _drawn(paths, usable, take)
        best, best_f, best_bin = np.full(len(size), -np.inf), np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for f in range(d):
            on = may[f][node]
            if not on.any():
                continue
            key = node[on] * BINS + bins[f][rows[on]]
            order = _order(key)
            key, run = key[order], np.cumsum(stats[rows[on][order]], axis=0)
            of = key // BINS
            cut = np.flatnonzero((key[1:] != key[:-1]) & (of[1:] == of[:-1]))
            first = np.searchsorted(of, of[cut])
            left = run[cut] - np.where((first > 0)[:, None], run[first - 1], 0.0)
            n = of[cut]
            gain = loss[n] - _loss(left, classes) - _loss(total[n] - left, classes)
            at = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]]))
            top = np.maximum.reduceat(gain, at)
            hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(at, len(n)))))
            hit = hit[np.concatenate([[True], n[hit][1:] != n[hit][:-1]])]
            better = top > best[n[at]]
            who = n[at][better]
            best[who], best_f[who], best_bin[who] = top[better], f, key[cut[hit]][better] % BINS
        np.add.at(gain_of, best_f, np.maximum(best, 0.0))
        splits += len(size)
        level += 1
        side = (bins[best_f[node], rows] > best_bin[node]).astype(np.int64)
        order = _order(node * 2 + side)
        rows, part = rows[order], (node * 2 + side)[order]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        side = part[start] & 1
        paths = np.where(side == 1, _child(paths[part[start] >> 1], 1), _child(paths[part[start] >> 1], 0))
    return gain_of, splits, level


def bin_edges(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Upper bounds of each feature's bins but the last: its distinct values where
    there are few, else quantiles."""
    x = {c: q(c) for c in features}
    near = df.agg(*[F.approx_count_distinct(x[c], 0.02).alias(f"n{i}") for i, c in enumerate(features)]).first()
    few = [i for i in range(len(features)) if near[f"n{i}"] <= BINS * 3 // 4]
    probs = [j / BINS for j in range(1, BINS)]
    row = df.agg(*[(F.collect_set(x[c]) if i in few else F.percentile_approx(x[c], probs, 100_000)).alias(f"e{i}") for i, c in enumerate(features)]).first()
    out = []
    for i in range(len(features)):
        v = np.unique(np.array(row[f"e{i}"] or [], float))
        out.append((v[:-1] if i in few else v)[:BINS - 1])
    return out


def _packs(df: DataFrame, features: list[str], target: str, edges: list[np.ndarray], classes: list | None) -> DataFrame:
    """(base, n, bins, y): packs of rows with ids base, base + 1, ..."""
    d, kind = len(features), _target_type(len(classes or []))
    size = max(1024, min(65_536, PACK_BYTES // (d + 8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, rows = TaskContext.get().partitionId() << 40, [], 0

        def pack(t: pa.Table) -> pa.RecordBatch:
            nonlocal base
            bins = np.stack([np.searchsorted(e, t.column(i).to_numpy(), "left") for i, e in enumerate(edges)]).astype(np.uint8)
            y = t.column(d).combine_chunks()
            y = np.asarray(pc.index_in(y, value_set=pa.array(classes, y.type)) if classes is not None else y).astype(kind)
            out = pa.RecordBatch.from_arrays([pa.array([base]), pa.array([len(y)]), pa.array([bins.tobytes()]), pa.array([y.tobytes()])],
                                             ["base", "n", "bins", "y"])
            base += len(y)
            return out

        for rb in batches:
            held.append(rb)
            rows += rb.num_rows
            while rows >= size:
                t = pa.Table.from_batches(held)
                yield pack(t.slice(0, size))
                held, rows = t.slice(size).to_batches(), rows - size
        if rows:
            yield pack(pa.Table.from_batches(held))

    return df.select(*[q(c) for c in features], q(target)).mapInArrow(run, "base long, n long, bins binary, y binary")


class Top:
    """Large nodes of a group of trees and their splits; children come in pairs."""

    def __init__(self, trees: list[int], seed: int):
        self.trees = trees
        self.path = np.array([_root(seed, t) for t in trees], _U)
        self.tree = np.arange(len(trees))
        self.feature = np.full(len(trees), -1)
        self.bin = np.zeros(len(trees), np.int64)
        self.left = np.zeros(len(trees), np.int64)
        self.small = np.zeros(len(trees), bool)   # grown in one task

    def parts(self, bins: np.ndarray, tree: int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its rows) of a pack's rows in a tree; only nodes without a split."""
        todo = [(tree, rows)]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            f = self.feature[node]
            if f < 0:
                yield node, rows
                continue
            go = bins[f][rows] > self.bin[node]
            todo += [(self.left[node] + 1, rows[np.flatnonzero(go)]), (self.left[node], rows[np.flatnonzero(~go)])]

    def split(self, node: int, feature: int, bin_: int) -> int:
        self.feature[node], self.bin[node], self.left[node] = feature, bin_, len(self.path)
        p = self.path[node:node + 1]
        self.path = np.concatenate([self.path, _child(p, 0), _child(p, 1)])
        self.tree = np.append(self.tree, [self.tree[node]] * 2)
        self.feature, self.bin, self.left = (np.append(a, [v] * 2) for a, v in ((self.feature, -1), (self.bin, 0), (self.left, 0)))
        self.small = np.append(self.small, [False] * 2)
        return int(self.left[node])


def _each(rb: pa.RecordBatch, d: int, classes: int):
    kind = _target_type(classes)
    for base, n, bins, y in zip(*rb.columns[:4]):
        yield np.arange(base.as_py(), base.as_py() + n.as_py()), np.frombuffer(bins.as_buffer(), np.uint8).reshape(d, -1), np.frombuffer(y.as_buffer(), kind)


def _histograms(packs: DataFrame, top: Top, asked: list[tuple[int, int]], d: int, classes: int) -> DataFrame:
    """(node, feature, sums by bin) of the nodes and features asked for, summed over all packs."""
    shared = packs.sparkSession.sparkContext.broadcast((top, asked))
    width = classes or 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, asked = shared.value
        of: dict[int, list] = {}
        for i, (node, f) in enumerate(asked):
            of.setdefault(node, []).append((i, f))
        trees = np.unique(top.tree[list(of)]).tolist()
        hist = np.zeros((len(asked), BINS, width))
        for rb in batches:
            for ids, bins, y in _each(rb, d, classes):
                for t in trees:
                    w = _weights(ids, top.path[t])
                    for node, rows in top.parts(bins, t, np.flatnonzero(w)):
                        if node not in of:
                            continue
                        w_, y_ = w[rows].astype(float), y[rows]
                        for i, f in of[node]:
                            key = bins[f][rows].astype(np.int64)
                            if classes:
                                hist[i] += np.bincount(key * classes + y_, w_, BINS * classes).reshape(BINS, classes)
                            else:
                                hist[i] += np.stack([np.bincount(key, v, BINS) for v in (w_, w_ * y_, w_ * y_ * y_)], axis=1)
        found = np.flatnonzero(hist.any((1, 2)))
        for lo in range(0, len(found), 1024):
            part = found[lo:lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array([int(asked[i][0]) for i in part]), pa.array([int(asked[i][1]) for i in part]),
                                              pa.array([hist[i].tobytes() for i in part])], ["node", "feature", "hist"])

    found = pa.schema([("node", pa.int64()), ("feature", pa.int64()), ("bin", pa.int64()), ("gain", pa.float64()), ("impure", pa.bool_()),
                       ("sizes", pa.list_(pa.float64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done() -> pa.RecordBatch:
            s = total.sum(0)
            loss = _loss(s, classes)
            run_ = np.cumsum(total, axis=0)
            some = total.any(1)
            gain = np.where(some[:-1] & (run_[:-1] != s).any(1), loss - _loss(run_[:-1], classes) - _loss(s - run_[:-1], classes), -np.inf)
            at = int(np.argmax(gain))
            values = [now[0], now[1], at, float(gain[at]) if np.isfinite(gain[at]) else None, bool(_impure(s, loss, classes)),
                      [float(x.sum() if classes else x[0]) for x in (run_[at], s - run_[at])]]
            return pa.RecordBatch.from_pylist([dict(zip(found.names, values))], schema=found)  # a gain may be null: types are given

        for rb in batches:
            for node, feature, hist in zip(*[c.to_pylist() for c in rb.columns]):
                if now != (node, feature):
                    if now:
                        yield done()
                    now, total = (node, feature), np.zeros((BINS, width))
                total += np.frombuffer(hist).reshape(BINS, width)
        if now:
            yield done()

    parts = packs.mapInArrow(run, "node long, feature long, hist binary")
    return (parts.repartition("node", "feature").sortWithinPartitions("node", "feature")
            .mapInArrow(add, "node long, feature long, bin long, gain double, impure boolean, sizes array<double>"))


def _subtrees(packs: DataFrame, top: Top, d: int, take: int, classes: int, depth: dict[int, int | None]) -> DataFrame:
    """(tree, gains, splits, levels) of every small node's subtree."""
    shared = packs.sparkSession.sparkContext.broadcast(top)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = shared.value
        for rb in batches:
            for ids, bins, y in _each(rb, d, classes):
                for lo in range(0, len(top.trees), 16):
                    rows = []
                    for t in range(lo, min(lo + 16, len(top.trees))):
                        w = _weights(ids, top.path[t])
                        for node, part in top.parts(bins, t, np.flatnonzero(w)):
                            if top.small[node]:
                                y_, w_ = y[part], w[part]
                                rows.append((int(node), int(ids[0]), bins.take(part, axis=1).tobytes(),
                                             *((_coded(y_, w_, classes).tobytes(), b"") if classes else (y_.tobytes(), w_.tobytes()))))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["node", "base", "bins", "y", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, now, held = shared.value, None, []

        def done() -> pa.RecordBatch:
            whole = lambda i, kind: [np.frombuffer(h[i].as_buffer(), kind) for h in held]
            bins = np.concatenate([b.reshape(d, -1) for b in whole(0, np.uint8)], axis=1)
            bound = depth.get(now) if depth else None
            if classes:
                code = np.concatenate(whole(1, _code_type(classes)))
                held.clear()
                gains, splits, levels = grow_classes(bins, code, top.path[now], take, classes, bound)
            else:
                y, w = (np.concatenate(whole(i, kind)) for i, kind in ((1, float), (2, np.uint8)))
                held.clear()
                gains, splits, levels = grow(bins, y, w.astype(float), top.path[now], take, classes, bound)
            return pa.RecordBatch.from_arrays([pa.array([int(top.tree[now])]), pa.array([gains.tolist()]), pa.array([splits]), pa.array([levels])],
                                              ["tree", "gains", "splits", "levels"])

        for rb in batches:
            for node, _, *rest in zip(rb.column(0).to_pylist(), *rb.columns[1:]):
                if node != now:
                    if held:
                        yield done()
                    now, held = node, []
                held.append(rest)
        if held:
            yield done()

    tasks = max(1, min(int(top.small.sum()), 20_000))
    return (packs.mapInArrow(deal, "node long, base long, bins binary, y binary, w binary").repartition(tasks, "node")
            .sortWithinPartitions("node", "base").mapInArrow(run, "tree long, gains array<double>, splits long, levels long"))


def tree_importances(df: DataFrame, features: list[str], target: str, classes: list | None, n_trees: int = 100, seed: int = 42,
                     max_depth: int | None = None, max_features: int | None = None, local_rows: int = LOCAL_ROWS) -> np.ndarray:
    """(tree, feature) sums of gains. ``classes`` are the target's values, None for
    a numeric target; features and target hold no nulls."""
    spark, d = df.sparkSession, len(features)
    n_classes = len(classes) if classes is not None else 0
    take = max_features or (max(1, int(d ** 0.5)) if classes is not None else d)
    base = f"{ensure_checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    made, cores = _packs(df, features, target, bin_edges(df, features), classes), spark.sparkContext.defaultParallelism
    # a pack is half a MB: dealt to files that all cores read alike while there are few
    if made.rdd.getNumPartitions() < 4 * cores:
        made = made.repartition(4 * cores)
    made.write.parquet(base)
    packs = spark.read.schema(made.schema).parquet(base)
    packs = packs.repartition(cores, "base") if packs.rdd.getNumPartitions() < cores else packs
    n = packs.agg(F.sum("n")).first()[0] or 0
    out = np.zeros((n_trees, d))
    if not n or n_classes == 1:
        return out
    together = max(1, min(n_trees, int(FRONTIER * local_rows // (2 * n)) if n > local_rows else n_trees))
    at_once = max(1, HIST_BYTES // (BINS * (n_classes or 3) * 8))
    for lo in range(0, n_trees, together):
        top = Top(list(range(lo, min(lo + together, n_trees))), seed)
        open_, level, depth = np.arange(len(top.trees)), 0, {}
        if n <= local_rows:
            top.small[:], open_ = True, open_[:0]
            depth = {i: max_depth for i in range(len(top.trees))}
        while len(open_) and (max_depth is None or level < max_depth):
            children, level = [], level + 1
            draws = dict(zip(open_.tolist(), _draws(top.path[open_], d).tolist()))
            best, seen = {}, dict.fromkeys(draws, 0)
            while draws:   # nodes whose drawn feature is constant draw another
                asked, draws_ = [], {}
                for node, left in draws.items():
                    want = take - seen[node]
                    asked += [(node, f) for f in left[:want]]
                    draws_[node] = left[want:]
                found = [r for a in range(0, len(asked), at_once)
                         for r in _histograms(packs, top, asked[a:a + at_once], d, n_classes).collect()]   # one row a pair
                pure = set()
                for r in found:
                    if not r["impure"]:
                        pure.add(r["node"])
                    elif r["gain"] is not None:
                        seen[r["node"]] += 1
                        best[r["node"]] = max(best.get(r["node"], r), r, key=lambda r: (r["gain"], -r["feature"]))
                draws = {node: left for node, left in draws_.items() if left and seen[node] < take and node not in pure}
            for node in sorted(best):
                r = best[node]
                out[lo + top.tree[node], r["feature"]] += max(r["gain"], 0.0)
                left = top.split(node, r["feature"], r["bin"])
                for side, size in enumerate(r["sizes"]):
                    if size > local_rows:
                        children.append(left + side)
                    else:
                        top.small[left + side] = True
                        depth[left + side] = None if max_depth is None else max_depth - level
            open_ = np.array(children, np.int64)
        if top.small.any():
            for r in (_subtrees(packs, top, d, take, n_classes, depth if max_depth is not None else {})
                      .select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).collect()):
                out[lo + r["tree"], r["f"]] += r["g"]
    return out


def importances(df: DataFrame, features: list[str], target: str, classes: list | None, **kw) -> dict[str, float]:
    """Mean over the trees of each tree's shares of gain, brought to the sum 1."""
    gains = tree_importances(df, features, target, classes, **kw)
    total = gains.sum(1, keepdims=True)
    shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).mean(0)
    return {f: float(s) for f, s in zip(features, shares / shares.sum() if shares.sum() else shares)}
