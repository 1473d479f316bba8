"""Model-based imputation (IMP-9 nearest neighbours, IMP-10 chained regression).

kNN (k = 5, uniform mean, NaN-Euclidean over all numeric columns) is exact, yet
a row is compared with few donors. Equal donors become one with a number. Each of the
commonest null patterns of rows has a k-d tree over the columns that its rows know, the
others share one over all columns (splits come from a bounded sample, so they touch
speed only). A tree's donors have a column that its rows lack; they are dealt to cells,
its leaves parted by which columns are null where such patterns are few; a cell has the box of its values, the columns that all or some of
its donors have, and its donors lie in packs of bounded size, so a full cell is many
tasks. The distance to a box, over the columns that every donor of the cell shares
with the row, bounds the distance to its donors from below. Boxes of neighbouring cells
are joined by ``FAN`` into boxes of boxes, so a row looks at few of them, not at all cells.
A row first visits near cells that hold k donors of each column it lacks; the k-th
distance found is an upper bound, and every other cell whose lower bound is under it is
visited then.
Rows and donors meet as pairs of packs in an equi-join on the cell; only the k best
of a row and column leave a pair, and a rank filter keeps the k best of all. A row
that shares no column with any donor gets the column's mean.

Chained regression: start from column means, then up to ``rounds`` passes over the
incomplete columns, the one with the fewest nulls first. Each column's ridge
regression on all others uses the values the columns before it got in the same
pass. Its normal equations come from Gram matrices summed over packs of rows in
NumPy (one array a task, whatever the number of columns); complete rows never
change, so theirs is summed once, and only incomplete rows are read again. New
values are row-local, so the pass's coefficients replay them: a table is written
once a pass, not once a column.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import q
from tessera.session import ensure_checkpoint_dir

CELL_ROWS = 2_048       # donors a cell is meant to hold
MOST_CELLS = 1 << 18    # boxes are broadcast: at most 2 x 8 bytes x columns for each
MOST_PATTERNS = 64
MOST_TREES = 8          # null patterns of rows that have a tree of their own
SAMPLE_ROWS = 200_000
PACK_ROWS = 1_024
FAN = 8                 # boxes joined into one of the next level
TOP_BOXES = 64          # boxes of the last level
_STEP = 4_096           # rows whose boxes are searched at once
_ROW = "_row_id"


# ------------------------------------------------------------------ IMP-9
def _tree(sample: np.ndarray, leaves: int) -> list[tuple]:
    """k-d splits (column, value, left, right) over a sample; negative children are
    leaves. Nulls go left."""
    nodes: list[tuple] = []
    count = 0

    def build(rows: np.ndarray, want: int) -> int:
        nonlocal count
        part = sample[rows]
        if want > 1 and len(rows) > 1:
            with np.errstate(all="ignore"):
                spread = np.nan_to_num(np.nanmax(np.where(np.isnan(part), -np.inf, part), 0) - np.nanmin(np.where(np.isnan(part), np.inf, part), 0),
                                       nan=0.0, neginf=0.0)
            f = int(np.argmax(spread))
            if spread[f] > 0:
                known = np.sort(part[~np.isnan(part[:, f]), f])
                cut = known[(len(known) - 1) // 2]
                if cut == known[-1]:
                    cut = known[np.searchsorted(known, cut) - 1]
                go = ~(part[:, f] > cut)
                at = len(nodes)
                nodes.append(())
                nodes[at] = (f, float(cut), build(rows[go], want // 2), build(rows[~go], want - want // 2))
                return at
        count += 1
        return -count

    build(np.arange(len(sample)), leaves)
    return nodes


def _leaf(nodes: list[tuple], X: np.ndarray) -> np.ndarray:
    if not nodes:
        return np.ones(len(X), np.int64)
    f, cut, left, right = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(X), np.int64)
    while (open_ := np.flatnonzero(at >= 0)).size:
        n = at[open_]
        at[open_] = np.where(X[open_, f[n]] > cut[n], right[n], left[n])
    return -at


def _matrix(rb: pa.RecordBatch, d: int, first: int = 0) -> np.ndarray:
    return np.column_stack([rb.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)]) if rb.num_rows else np.zeros((0, d))


class _Cells:
    """Boxes of the cells, sorted by cell: least and greatest value, number of
    donors by column, donors."""

    def __init__(self, rows, d: int):
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        grid = lambda name: np.array([[np.nan if v is None else v for v in r[name]] for r in rows], float).reshape(len(rows), d)
        self.low, self.high, self.has = grid("low"), grid("high"), grid("has")
        self.all = self.has == np.array([r["n"] for r in rows], float)[:, None]
        self.d, self.fan = d, FAN
        self.levels = [(self.low, self.high, self.has, self.all)]
        while len(self.levels[-1][0]) > TOP_BOXES:
            low, high, has, every = self.levels[-1]
            at = np.arange(0, len(low), self.fan)
            self.levels.append((np.fmin.reduceat(low, at), np.fmax.reduceat(high, at), np.add.reduceat(has, at), np.logical_and.reduceat(every, at)))

    def _bound(self, level: int, x: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """``bounds`` of pairs: the rows' values by column against boxes of a level."""
        low, high, has, every = self.levels[level]
        total, most = np.zeros(at.shape), np.zeros(at.shape)
        for j in range(self.d):
            known = ~np.isnan(x[j])
            if not known.any():
                continue
            with np.errstate(invalid="ignore"):
                gap = np.maximum(np.maximum(low[at, j] - x[j], x[j] - high[at, j]), 0.0)
            total += np.where(known & every[at, j], gap * gap, 0.0)
            most += known & (has[at, j] > 0)
        return np.where(most > 0, total * (self.d / np.maximum(most, 1)) * (1 - 1e-9), np.inf)

    def nearest(self, X: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: near cells that hold k donors of each column a row lacks, found
        from the last level down among the boxes nearest at each level."""
        if len(self.levels) == 1:
            near = self.first(X, self.bounds(X), k)
            return np.repeat(np.arange(len(X)), [len(n) for n in near]), np.concatenate([np.zeros(0, np.int64), *near])
        keep, pairs = max(4, k), [np.zeros(0, np.int64)]
        for j in range(self.d):
            rows = np.flatnonzero(np.isnan(X[:, j]))
            if not len(rows):
                continue
            x = [X[rows, i][:, None] for i in range(self.d)]
            at = np.tile(np.arange(len(self.levels[-1][0])), (len(rows), 1))
            for level in range(len(self.levels) - 1, -1, -1):
                has = self.levels[level][2]
                out = at >= len(has)
                at[out] = 0
                bound = self._bound(level, x, at)
                bound[out | (has[at, j] == 0)] = np.inf
                if level:
                    near = np.argpartition(bound, keep - 1, axis=1)[:, :keep] if bound.shape[1] > keep else np.tile(np.arange(bound.shape[1]), (len(rows), 1))
                    at = np.where(np.isfinite(np.take_along_axis(bound, near, 1)), np.take_along_axis(at, near, 1), len(has))
                    at = (at[:, :, None] * self.fan + np.arange(self.fan)).reshape(len(rows), -1)
            order = np.argsort(bound, axis=1, kind="stable")
            bound, at = np.take_along_axis(bound, order, 1), np.take_along_axis(at, order, 1)
            some = np.where(np.isfinite(bound), self.has[at, j], 0.0)
            who, place = np.nonzero((some > 0) & (np.cumsum(some, axis=1) - some < k))
            pairs.append(rows[who] * len(self.cell) + at[who, place])
        return np.divmod(np.unique(np.concatenate(pairs)), len(self.cell))

    def within(self, X: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) pairs: every cell that holds donors of a column the row lacks and
        whose bound is not over the row's ``u`` of that column."""
        top, lacks = len(self.levels[-1][0]), np.isnan(X)
        who, at = np.repeat(np.arange(len(X)), top), np.tile(np.arange(top), len(X))
        for level in range(len(self.levels) - 1, -1, -1):
            bound, has = self._bound(level, [X[who, j] for j in range(self.d)], at), self.levels[level][2]
            may = np.zeros(len(at), bool)
            for j in range(self.d):
                may |= lacks[who, j] & (bound <= u[who, j]) & (has[at, j] > 0)
            on = np.flatnonzero(may & np.isfinite(bound))
            who, at = who[on], at[on]
            if level:
                if len(at) > 1 << 18 and len(X) > 1:   # far rows see many boxes: fewer at once
                    half = len(X) // 2
                    (a, b), (c, e) = self.within(X[:half], u[:half]), self.within(X[half:], u[half:])
                    return np.concatenate([a, c + half]), np.concatenate([b, e])
                who, at = np.repeat(who, self.fan), (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                on = np.flatnonzero(at < len(self.levels[level - 1][0]))
                who, at = who[on], at[on]
        return who, at

    def bounds(self, X: np.ndarray) -> np.ndarray:
        """Lower bound of the squared distance from each row to each cell's donors;
        inf where they share no column."""
        known = ~np.isnan(X)
        total = np.zeros((len(X), len(self.cell)))
        for j in range(self.d):
            if known[:, j].any() and self.all[:, j].any():
                x = X[:, j:j + 1]
                with np.errstate(invalid="ignore"):
                    gap = np.maximum(np.maximum(self.low[:, j] - x, x - self.high[:, j]), 0.0)
                total += np.where(known[:, j:j + 1] & self.all[:, j], gap * gap, 0.0)
        most = known.astype(float) @ (self.has > 0).T.astype(float)
        with np.errstate(divide="ignore"):
            return np.where(most > 0, total * (self.d / np.maximum(most, 1)) * (1 - 1e-9), np.inf)

    def first(self, X: np.ndarray, bound: np.ndarray, k: int) -> list[np.ndarray]:
        """For each row the nearest cells that hold k donors of each column it lacks."""
        order, out = np.argsort(bound, axis=1, kind="stable"), []
        for i in range(len(X)):
            lacks = np.isnan(X[i])
            near = order[i][np.isfinite(bound[i][order[i]])]
            enough = (np.cumsum(self.has[near][:, lacks], axis=0) >= k).all(1)
            out.append(near[:int(np.argmax(enough)) + 1] if enough.any() else near)
        return out


def _tree_of(X: np.ndarray, trees: list[int | None]) -> np.ndarray:
    """Tree of each row: that of its null pattern, else the shared one; -1 where a row
    knows nothing."""
    gaps = np.isnan(X)
    out = np.full(len(X), trees.index(None) if None in trees else -1)
    if X.shape[1] <= 62:
        mask = gaps @ (1 << np.arange(X.shape[1]))
        for t, pattern in enumerate(trees):
            if pattern is not None:
                out[mask == pattern] = t
    return np.where(gaps.all(1), -1, out)


def _visits(rows: DataFrame, cells_of: list["_Cells"], trees: list[int | None], d: int, k: int, bounded: bool) -> DataFrame:
    """(cell, ids, values): packs of the rows that visit a cell - the first cells,
    or with the k-th squared distances ``u`` known, the rest that may hold nearer donors."""
    shared = rows.sparkSession.sparkContext.broadcast(cells_of)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def pack(cell: int) -> tuple:
            got = held.pop(cell)
            return cell, np.concatenate([g[0] for g in got]).tobytes(), np.concatenate([g[1] for g in got]).tobytes()

        def batch(packs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*packs)], ["cell", "ids", "x"])

        def parts(rb: pa.RecordBatch):
            tree = _tree_of(_matrix(rb, d, 1), trees)
            for t, cells in enumerate(shared.value):
                mine = rb.take(pa.array(np.flatnonzero(tree == t)))
                for lo in range(0, mine.num_rows, _STEP):
                    yield cells, mine.slice(lo, _STEP)

        waiting = 0
        for rb in batches:
            for cells, part in parts(rb):
                ids, X = part.column(0).to_numpy(), _matrix(part, d, 1)
                at, c = cells.nearest(X, k)
                if bounded:
                    u = part.column(1 + d).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    near = at * len(cells.cell) + c
                    at, c = cells.within(X, np.where(np.isnan(u), np.inf, u))
                    on = np.flatnonzero(~np.isin(at * len(cells.cell) + c, near))
                    at, c = at[on], c[on]
                order = np.argsort(c, kind="stable")
                at, c = at[order], c[order]
                cuts = np.flatnonzero(np.diff(c)) + 1
                packs = []
                for a, b in zip([0, *cuts], [*cuts, len(c)]) if len(c) else ():
                    cell = int(cells.cell[c[a]])
                    for s in range(a, b, PACK_ROWS):
                        rows_ = at[s:min(s + PACK_ROWS, b)]
                        held.setdefault(cell, []).append((ids[rows_], X[rows_]))
                        waiting += len(rows_)
                    if sum(len(g[0]) for g in held[cell]) >= PACK_ROWS:
                        waiting -= sum(len(g[0]) for g in held[cell])
                        packs.append(pack(cell))
                if waiting > 1 << 18:
                    packs += [pack(cell) for cell in list(held)]
                    waiting = 0
                if packs:
                    yield batch(packs)
        for lo in range(0, len(held), 64):
            yield batch([pack(cell) for cell in list(held)[:64]])

    return rows.mapInArrow(run, "cell long, ids binary, x binary")


def _best(visits: DataFrame, donors: DataFrame, d: int, k: int) -> DataFrame:
    """(row, j, dist, tie, value, n): the k nearest donors with column j of each
    pair of packs; squared distances."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for ids, x, y, tie, many in zip(*[rb.column(i).to_pylist() for i in range(5)]):
                ids, X, Y = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, d), np.frombuffer(y).reshape(-1, d)
                tie, many, out = np.frombuffer(tie, np.int64), np.frombuffer(many, np.int64), []
                for lo in range(0, len(X), max(1, (1 << 20) // len(Y))):
                    part = X[lo:lo + max(1, (1 << 20) // len(Y))]
                    total, shared = np.zeros((len(part), len(Y))), np.zeros((len(part), len(Y)))
                    for j in range(d):
                        gap = part[:, j:j + 1] - Y[:, j]
                        both = ~np.isnan(gap)
                        total += np.where(both, gap * gap, 0.0)
                        shared += both
                    with np.errstate(divide="ignore", invalid="ignore"):
                        dist = np.where(shared > 0, total * (d / shared), np.inf)
                    for j in range(d):
                        need, has = np.flatnonzero(np.isnan(part[:, j])), np.flatnonzero(~np.isnan(Y[:, j]))
                        if not len(need) or not len(has):
                            continue
                        dj = dist[np.ix_(need, has)]
                        kth = np.partition(dj, min(k, len(has)) - 1, axis=1)[:, min(k, len(has)) - 1]
                        r, c = np.nonzero((dj <= kth[:, None]) & np.isfinite(dj))
                        order = np.lexsort((tie[has[c]], dj[r, c], r))
                        r, c = r[order], c[order]
                        place = np.arange(len(r)) - np.searchsorted(r, r)
                        r, c = r[place < k], c[place < k]
                        out.append((ids[lo + need[r]], np.full(len(r), j, np.int32), dj[r, c], tie[has[c]], Y[has[c], j], many[has[c]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["row", "j", "dist", "tie", "value", "n"])

    return (visits.join(donors, "cell").select("ids", "x", "y", "tie", "many")
            .mapInArrow(run, "row long, j int, dist double, tie long, value double, n long"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row and column, equal donors counted as often as they stand."""
    w = Window.partitionBy("row", "j").orderBy("dist", "tie")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
            .withColumn("take", F.least(F.col("n"), F.lit(k) - before)).filter("take > 0").drop("_r", "n"))


def knn_impute(df: DataFrame, cols: list[str], k: int = 5, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Fill every numeric column's nulls with the mean of the k nearest
    donors that have the column (NaN-Euclidean over ``cols``)."""
    spark, d = df.sparkSession, len(cols)
    base_dir = f"{ensure_checkpoint_dir(spark)}/knn-{uuid.uuid4().hex}"

    def stored(name: str, table: DataFrame) -> DataFrame:
        table.write.parquet(f"{base_dir}/{name}")
        return spark.read.schema(table.schema).parquet(f"{base_dir}/{name}")

    base = stored("base", df.withColumn(_ROW, F.monotonically_increasing_id()))  # stable ids
    x = [F.nanvl(q(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(cols)]
    names = [f"x{i}" for i in range(d)]
    lacks = " or ".join(f"{n} is null" for n in names)
    # a donor's place among equally near ones is a hash of its values: the same in every layout
    distinct = (base.select(F.xxhash64(*[q(c) for c in cols]).alias("tie"), *x).groupBy("tie", *names).agg(F.count(F.lit(1)).alias("many"))
                .filter(F.coalesce(*names).isNotNull()))
    distinct = stored("donors", distinct.withColumn("mask", sum((F.col(n).isNull().cast("long") * (1 << (i % 62)) for i, n in enumerate(names)), F.lit(0))))
    about = distinct.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("mask").alias("masks")).first()
    means = base.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    if not about["n"]:
        return base.drop(_ROW)
    apart = about["masks"] <= MOST_PATTERNS
    todo = base.select(_ROW, *x).filter(lacks)
    nulls = sum((F.col(n).isNull().cast("long") * (1 << (i % 62)) for i, n in enumerate(names)), F.lit(0))
    common = (todo.filter(F.coalesce(*names).isNotNull()).groupBy(nulls.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.desc("n"), "mask").limit(MOST_TREES + 1).collect()) if d <= 62 else []
    trees: list[int | None] = [r["mask"] for r in common] if 0 < len(common) <= MOST_TREES else [*[r["mask"] for r in common[:MOST_TREES - 1]], None]
    leaves = max(1, min(MOST_CELLS // (len(trees) * (about["masks"] if apart else 1)), about["n"] // cell_rows))
    share = min(1.0, min(SAMPLE_ROWS, 32 * leaves) / about["n"])
    picked = distinct.filter(F.pmod("tie", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(*names).limit(2 * SAMPLE_ROWS).toArrow() if leaves > 1 else None
    sample = np.column_stack([picked[n].to_numpy().astype(float) for n in names]) if picked is not None and picked.num_rows else None
    unknown = [np.array([pattern is not None and bool(pattern >> i & 1) for i in range(d)]) for pattern in trees]
    nodes = [_tree(np.where(u, np.nan, sample), leaves) if sample is not None else [] for u in unknown]

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            X = _matrix(rb, d, 1)
            for t, u in enumerate(unknown):
                at = np.flatnonzero(~np.isnan(X[:, u]).all(1)) if u.any() else np.arange(len(X))
                mine = rb.take(pa.array(at))
                mask = mine.column(d + 2).to_numpy()
                yield pa.RecordBatch.from_arrays([*mine.columns[:d + 2], pa.array(np.full(len(at), t)), pa.array(_leaf(nodes[t], X[at])),
                                                  pa.array(mask if apart else np.zeros_like(mask))], ["tie", *names, "many", "tree", "leaf", "mask"])

    schema = "tie long, " + ", ".join(f"{n} double" for n in names) + ", many long, tree long, leaf long, mask long"
    placed = distinct.select("tie", *names, "many", "mask").mapInArrow(celled, schema).withColumn("cell", F.xxhash64("tree", "leaf", "mask"))
    boxes = placed.groupBy("cell", "tree").agg(F.min("mask").alias("mask"), F.min("leaf").alias("leaf"), F.count(F.lit(1)).alias("n"), F.array(*[F.min(n) for n in names]).alias("low"),
                                               F.array(*[F.max(n) for n in names]).alias("high"), F.array(*[F.count(n) for n in names]).alias("has"))
    found = sorted(boxes.collect(), key=lambda r: (r["mask"], r["leaf"], r["cell"]))  # at most MOST_CELLS rows; leaves are numbered from side to side
    cells = [_Cells([r for r in found if r["tree"] == t], d) for t in range(len(trees))]
    packs = spark.createDataFrame([(r["cell"], r["n"] // (2 * PACK_ROWS) + 1) for r in found], "cell long, packs long")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> tuple:
            return key[0], *(np.concatenate(c).tobytes() for c in zip(*held))

        for rb in batches:
            cell, part = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            X, tie, many = _matrix(rb, d, 2), rb.column(d + 2).to_numpy(), rb.column(d + 3).to_numpy()
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts], [*cuts, len(cell)]):
                if key != (cell[a], part[a]):
                    if held:
                        out.append(done())
                    key, held = (cell[a], part[a]), []
                held.append((X[a:b], tie[a:b], many[a:b]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["cell", "y", "tie", "many"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in done()], ["cell", "y", "tie", "many"])

    donors = stored("cells", placed.join(F.broadcast(packs), "cell").withColumn("part", F.pmod("tie", "packs"))
                    .repartition("cell", "part").sortWithinPartitions("cell", "part").select("cell", "part", *names, "tie", F.least("many", F.lit(k)).alias("many"))
                    .mapInArrow(packed, "cell long, y binary, tie binary, many binary"))

    if todo.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        todo = todo.repartition(spark.sparkContext.defaultParallelism, _ROW)
    near = stored("near", _ranked(_best(_visits(todo, cells, trees, d, k, False), donors, d, k), k))
    kth = (near.groupBy("row", "j").agg(F.sum("take").alias("n"), F.max("dist").alias("u")).filter(F.col("n") >= k)
           .groupBy("row").agg(*[F.max(F.when(F.col("j") == j, F.col("u"))).alias(f"u{j}") for j in range(d)]))
    known = todo.join(kth, todo[_ROW] == kth["row"], "left").select(_ROW, *names, F.array(*[f"u{j}" for j in range(d)]).alias("u"))
    far = _best(_visits(known, cells, trees, d, k, True), donors, d, k)
    best = _ranked(near.withColumnRenamed("take", "n").unionByName(far), k)
    fills = best.groupBy("row").agg(*[(F.sum(F.when(F.col("j") == j, F.col("value") * F.col("take"))) / F.sum(F.when(F.col("j") == j, F.col("take")))).alias(f"_f{j}")
                                      for j in range(d)])
    out = base.join(fills, base[_ROW] == fills["row"], "left")
    return out.select(*[F.coalesce(F.nanvl(q(c).cast("double"), F.lit(None)), F.col(f"_f{cols.index(c)}"), F.lit(means[f"m{cols.index(c)}"]).cast("double")).alias(c)
                        if c in cols else q(c) for c in df.columns])


# ----------------------------------------------------------------- IMP-10
def _gram(rows: DataFrame, d: int, steps: list[tuple[int, np.ndarray]], of: int | None) -> np.ndarray:
    """Sum over rows of [1, x]'[1, x], after the steps (column, coefficients) filled
    in; only of rows that have column ``of``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        G = np.zeros((d + 1, d + 1))
        for rb in batches:
            X, gaps = _replayed(rb, d, steps)
            if of is not None:
                X = X[~gaps[:, of]]
            A = np.column_stack([np.ones(len(X)), X])
            G += A.T @ A
        yield pa.RecordBatch.from_arrays([pa.array(np.arange((d + 1) ** 2)), pa.array(G.ravel())], ["i", "g"])

    parts = rows.mapInArrow(run, "i long, g double").groupBy("i").agg(F.sum("g").alias("g")).collect()
    G = np.zeros((d + 1) ** 2)
    for r in parts:
        G[r["i"]] = r["g"]
    return G.reshape(d + 1, d + 1)


def _replayed(rb: pa.RecordBatch, d: int, steps: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values, was null) of a batch of (values, null flags) after the steps."""
    X = _matrix(rb, d)
    gaps = np.column_stack([rb.column(d + i).to_numpy(zero_copy_only=False) for i in range(d)]) if rb.num_rows else np.zeros((0, d), bool)
    for j, beta in steps:
        at = gaps[:, j]
        X[at, j] = np.column_stack([np.ones(int(at.sum())), np.delete(X[at], j, axis=1)]) @ beta
    return X, gaps


def chained_regression(df: DataFrame, cols: list[str], rounds: int = 10, ridge: float = 1e-6,
                       tol: float = 1e-3) -> DataFrame:
    """Iterative ridge imputation of every incomplete numeric column, starting
    from column means, the columns one after the other. Stops when the largest
    change of an imputed cell in a pass is below tol x the largest observed |value|."""
    spark, d = df.sparkSession, len(cols)
    base_dir = f"{ensure_checkpoint_dir(spark)}/chained-{uuid.uuid4().hex}"
    x = [F.nanvl(q(c).cast("double"), F.lit(None)) for c in cols]
    stats = df.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(x)], *[F.count_if(v.isNull()).alias(f"z{i}") for i, v in enumerate(x)],
                   *[F.max(F.abs(v)).alias(f"x{i}") for i, v in enumerate(x)]).first()
    # a column without any value has nothing to learn from and stays as it is
    todo = sorted((i for i in range(d) if stats[f"z{i}"] and stats[f"a{i}"] is not None), key=lambda i: stats[f"z{i}"])
    used = [i for i in range(d) if stats[f"a{i}"] is not None]
    if not todo or len(used) < 2:
        return df.select(*[F.coalesce(q(c), F.lit(stats[f"a{cols.index(c)}"])).alias(c) if c in cols and cols.index(c) in todo else q(c) for c in df.columns])
    scale = max(stats[f"x{i}"] or 0.0 for i in used) or 1.0
    names, flags = [f"x{i}" for i in used], [f"g{i}" for i in used]
    d, todo = len(used), [used.index(i) for i in todo]
    schema = f"{_ROW} long, " + ", ".join(f"{n} double" for n in names) + ", " + ", ".join(f"{g} boolean" for g in flags)
    df.withColumn(_ROW, F.monotonically_increasing_id()).write.parquet(f"{base_dir}/rows")
    rows = spark.read.parquet(f"{base_dir}/rows")
    start = rows.select(_ROW, *[F.coalesce(x[i], F.lit(stats[f"a{i}"])).alias(n) for i, n in zip(used, names)], *[x[i].isNull().alias(g) for i, g in zip(used, flags)])
    any_gap = F.greatest(*[F.col(g) for g in flags])
    whole = _gram(start.filter(~any_gap).drop(_ROW), d, [], None)
    cur = start.filter(any_gap)
    for turn in range(rounds):
        steps: list[tuple[int, np.ndarray]] = []
        for j in todo:
            G = whole + _gram(cur.drop(_ROW), d, steps, j)
            keep = [i for i in range(d + 1) if i != j + 1]
            A, y = G[np.ix_(keep, keep)], G[keep, j + 1]
            steps.append((j, np.linalg.solve(A + ridge * (np.trace(A) / len(keep)) * np.eye(len(keep)), y)))

        def replay(batches: Iterator[pa.RecordBatch], steps=steps) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                part = rb.select([*names, *flags])
                X, _ = _replayed(part, d, steps)
                moved = np.abs(X - _matrix(part, d)).max(1) if rb.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([rb.column(0), *[pa.array(X[:, i]) for i in range(d)], *part.columns[d:], pa.array(moved)],
                                                 [_ROW, *names, *flags, "moved"])

        cur.select(_ROW, *names, *flags).mapInArrow(replay, schema + ", moved double").write.parquet(f"{base_dir}/pass-{turn}")
        cur = spark.read.schema(schema + ", moved double").parquet(f"{base_dir}/pass-{turn}")
        change = cur.agg(F.max("moved")).first()[0] or 0.0
        cur = cur.drop("moved")
        if change <= tol * scale:
            break
    filled = cur.select(F.col(_ROW).alias("_r"), *[F.col(n).alias(f"_v{n}") for n in names])
    out = rows.join(filled, rows[_ROW] == filled["_r"], "left")
    place = {cols[i]: n for i, n in zip(used, names)}
    return out.select(*[F.coalesce(F.nanvl(q(c).cast("double"), F.lit(None)), F.col(f"_v{place[c]}")).alias(c) if c in place else q(c) for c in df.columns])
