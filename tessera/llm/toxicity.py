"""Toxicity by maximum-scoring segments.

Learning (from a bounded, hash-chosen sample of labelled documents): for every
token and every token stem of 4 to 6 bytes the number of toxic and of clean
documents that hold it gives a log-odds ratio with an informative Dirichlet
prior (the prior of a unit is the class's overall rate). Copies and most near
copies - documents that share their smallest shingle hash - count as one, or a
single document copied often would look like many that agree. Units whose ratio is
significant form a lexicon; a token scores as its longest unit in the lexicon,
every other token as ``DRIFT``, so the expected score of clean text is negative.

Scoring: a linear scan finds the maximum-scoring segment of every document, and
the scan for all maximal segments (each a passage that cannot be extended or
split to score more) runs over the documents whose maximum is significant.
Under the clean model the maximum of n tokens follows an extreme-value law,
P(max >= s) = 1 - exp(-K n exp(-lambda s)); lambda solves E[exp(lambda score)]
= 1 over clean tokens, K is fitted to clean documents. A logistic curve over
the calibrated evidence of the best and of all significant segments turns it
into a score in 0..1.

The lexicon (at most ``LEXICON`` units) and the sample (at most ``SAMPLE``
documents) are the classifier's documented bounds; scoring covers all rows,
whole texts, in one map-only pass. Null and empty texts, and all texts if no
labelled document is toxic or none is clean, get the score of no evidence.
Equal texts score alike; repeated labels of one id count once, as toxic if any
says so. Labels, language, source and id are no inputs of a score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import LOWER, mix, prefix, shingles, sliced, spans, words

SAMPLE = 20_000
LEXICON = 1 << 17
STEMS = (4, 5, 6)
PRIOR = 20.0       # documents' worth of prior behind the test of a unit
SCORE_PRIOR = 2.0  # and behind its score
MIN_DOCS = 3
Z = 4.0
DRIFT = -0.05
TOP = 8.0
_U = np.uint64

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[97:123] = _TOKEN[128:] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, in place of their bytes."""
    out = LOWER[data]
    high = np.flatnonzero(data[:-1] == 0xC3) + 1
    high = high[(data[high] >= 0x80) & (data[high] <= 0x9E) & (data[high] != 0x97)]
    out[high] += 32
    return out


def token_units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document, token hash, hashes of the stems - 0 where the token is not longer)."""
    data = folded(data)
    solid = _TOKEN[data]
    left = np.zeros(len(solid), bool)
    left[1:] = solid[:-1]
    left[off[:-1][off[:-1] < len(solid)]] = False
    right = np.zeros(len(solid), bool)
    right[:-1] = solid[1:]
    right[off[1:][off[1:] > 0] - 1] = False
    start, end = np.flatnonzero(solid & ~left), np.flatnonzero(solid & ~right) + 1
    sums = prefix(data)
    doc = np.searchsorted(off, start, "right") - 1
    stems = []
    for k in STEMS:
        h = mix(spans(sums, start, np.minimum(start + k, end)) + _U(k))
        h[end - start <= k] = 0
        stems.append(h)
    return doc, spans(sums, start, end), stems


def in_training(id_col: str = "doc_id") -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def training_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``limit`` labelled documents, by a hash of the
    id. Only the chosen ids (a list of bounded size) are broadcast, so texts
    are not shuffled."""
    ids = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).filter(in_training())
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return picked.join(F.broadcast(ids), "doc_id").select("text", "toxic")


def one_per_class(sample: DataFrame) -> DataFrame:
    """One text of each group of copies: those with the same smallest hash of
    their three-word shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for a, b, data, off in sliced(rb.column(0)):
                start, end, counts = words(folded(data), off)
                h, k = shingles(spans(prefix(data), start, end), counts, 3)
                ends = np.concatenate([[0], np.cumsum(k)])
                least = np.zeros(b - a, np.uint64)
                if len(h):
                    least[k > 0] = np.minimum.reduceat(h, ends[:-1][k > 0])
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rb.columns], pa.array(least.view(np.int64))],
                                                 ["text", "toxic", "class"])
    return (sample.mapInArrow(run, "text string, toxic int, class long")
            .groupBy("class").agg(F.max(F.struct("toxic", "text")).alias("m")).select("m.text", "m.toxic"))


def _unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents that hold the unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            toxic = rb.column(1).to_numpy(zero_copy_only=False) > 0
            for a, b, data, off in sliced(rb.column(0)):
                doc, token, stems = token_units(data, off)
                every = np.stack([np.tile(doc, 1 + len(STEMS)).astype(np.uint64), np.concatenate([token, *stems])], 1)
                every = np.unique(every[every[:, 1] != 0], axis=0)
                unit, at = np.unique(every[:, 1], return_inverse=True)
                t = np.bincount(at, weights=toxic[a:b][every[:, 0].astype(np.int64)], minlength=len(unit)).astype(np.int64)
                n = np.bincount(at, minlength=len(unit))
                yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(t), pa.array(n - t)],
                                                 ["unit", "toxic", "clean"])
    return (sample.mapInArrow(run, "unit long, toxic long, clean long")
            .groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


class Model:
    """Lexicon (sorted unit hashes, scores) and calibration; a few MB at most."""

    def __init__(self, unit: np.ndarray, score: np.ndarray):
        order = np.argsort(unit)
        self.unit, self.score = unit[order], score[order]
        self.lam, self.k, self.curve = 1.0, 1.0, (-10.0, 0.0, 0.0)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.unit):
            return np.zeros(len(h), bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.unit, h), len(self.unit) - 1)
        return (self.unit[at] == h) & (h != 0), self.score[at]

    def token_scores(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, token, stems = token_units(data, off)
        out = np.full(len(doc), DRIFT)
        for h in [*stems, token]:  # shortest first, so the longest unit known has the last word
            ok, s = self._find(h)
            out[ok] = s[ok]
        return doc, out

    def evidence(self, s, n):
        """-log10 P(some segment of n clean tokens scores s or more)."""
        x = np.log(max(self.k, 1e-12)) + np.log(np.maximum(n, 1)) - self.lam * np.maximum(s, 0)
        p = -np.expm1(-np.exp(np.minimum(x, 50)))
        # exp(x) stands for p where p is too small to tell from 0
        return np.where(x < -20, -x / np.log(10), -np.log10(np.maximum(p, 1e-300)))

    def segments(self, score: np.ndarray) -> list[tuple[int, int, float]]:
        """All maximal-scoring segments (start, end, score) in one pass, in linear
        time: a candidate merges back with the nearest earlier one that began lower,
        if it ends higher. Each candidate keeps the place of that one, so a search
        steps over all that began higher at once."""
        start, end, low, high, below = [], [], [], [], []
        sums = np.concatenate([[0.0], np.cumsum(score)])
        positive = np.flatnonzero(score > 0)
        for i, left, right in zip(positive.tolist(), sums[positive].tolist(), sums[positive + 1].tolist()):
            first, j = i, len(low) - 1
            while j >= 0 and low[j] >= left:
                j = below[j]
            while j >= 0 and high[j] < right:
                first, left = start[j], low[j]
                up = below[j]
                del start[j:], end[j:], low[j:], high[j:], below[j:]
                j = up
            for column, v in ((start, first), (end, i + 1), (low, left), (high, right), (below, j)):
                column.append(v)
        return [(a, b, r - lo) for a, b, lo, r in zip(start, end, low, high)]

    def document_evidence(self, data: np.ndarray, off: np.ndarray, significant: float = 1.0):
        """(tokens, best segment's score, evidence of the best, summed evidence
        of all significant segments) of each document."""
        doc, score = self.token_scores(data, off)
        docs = len(off) - 1
        n = np.bincount(doc, minlength=docs)
        best = np.zeros(docs)
        if len(doc):
            # running minima restart with each document: its sums lie below all earlier ones
            drop = float(np.abs(score).sum()) + 1.0
            sums = np.cumsum(score) - doc * drop
            before = sums - score
            low = np.minimum.accumulate(before)
            np.maximum.at(best, doc, sums - low)
        first = self.evidence(best, n)
        every = np.where(first >= significant, first, 0.0)
        begin = np.concatenate([[0], np.cumsum(n)])
        for d in np.flatnonzero(first >= significant):
            ev = [self.evidence(s, n[d]) for _, _, s in self.segments(score[begin[d]:begin[d + 1]])]
            every[d] = sum(float(x) for x in ev if x >= significant)
        return n, best, first, every

    def probability(self, first: np.ndarray, every: np.ndarray) -> np.ndarray:
        c0, c1, c2 = self.curve
        return 1 / (1 + np.exp(-np.clip(c0 + c1 * np.minimum(first, 50) + c2 * np.log1p(every), -30, 30)))


def _sample_scores(sample: DataFrame, model: Model) -> list[tuple]:
    """One small row per sampled document: at most ``SAMPLE`` rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            toxic = rb.column(1)
            for a, b, data, off in sliced(rb.column(0)):
                n, best, first, every = model.document_evidence(data, off)
                yield pa.RecordBatch.from_arrays([toxic.slice(a, b - a), pa.array(n), pa.array(best), pa.array(first), pa.array(every)],
                                                 ["toxic", "n", "best", "first", "every"])
    return sample.mapInArrow(run, "toxic int, n long, best double, first double, every double").collect()


def _score_histogram(sample: DataFrame, model: Model) -> list[tuple]:
    """(score in steps of 0.01, tokens) over the clean documents of the sample."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for _, _, data, off in sliced(rb.column(0)):
                _, score = model.token_scores(data, off)
                v, c = np.unique(np.round(score * 100).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(c)], ["v", "n"])
    return (sample.filter("toxic = 0").mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n")).collect())


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a ridge logistic curve with intercept."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """Lexicon, extreme-value parameters and curve from the labelled sample."""
    sample = one_per_class(training_sample(docs, labels, limit)).checkpoint()
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = size.get(1, 0), size.get(0, 0)
    if not t or not c:
        return Model(np.zeros(0, np.uint64), np.zeros(0))
    rate = t / (t + c)
    def odds(prior: float) -> Column:  # of the class given the unit, against the classes' overall odds
        return F.log((F.col("toxic") + prior * rate) / (F.col("clean") + prior * (1 - rate))) - F.lit(float(np.log(rate / (1 - rate))))

    sd = F.sqrt(1 / (F.col("toxic") + PRIOR * rate) + 1 / (F.col("clean") + PRIOR * (1 - rate)))
    units = (_unit_counts(sample).filter(F.col("toxic") + F.col("clean") >= MIN_DOCS)
             .select("unit", odds(SCORE_PRIOR).alias("score"), (F.abs(odds(PRIOR)) / sd).alias("z")).filter(F.col("z") >= Z)
             .orderBy(F.desc("z"), "unit").limit(LEXICON).select("unit", "score").toArrow())
    score = np.clip(units["score"].to_numpy(), -1.0, TOP)
    model = Model(units["unit"].to_numpy().view(np.uint64), score + DRIFT)
    hist = np.array([(r["v"] / 100, r["n"]) for r in _score_histogram(sample, model)])
    if len(hist) and (hist[:, 0] > 0).any():
        s, p = hist[:, 0], hist[:, 1] / hist[:, 1].sum()
        if (s * p).sum() < 0:
            lo, hi = 1e-3, 20.0
            for _ in range(80):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
            model.lam = lo
        else:
            model.lam = 1e-3
    rows = _sample_scores(sample, model)
    clean = [(r["n"], r["best"]) for r in rows if not r["toxic"] and r["n"]]
    if clean:
        n, best = np.array(clean).T
        model.k = len(n) / max(float((n * np.exp(-model.lam * best)).sum()), 1e-9)
    rows = _sample_scores(sample, model)
    x = np.array([(min(r["first"], 50), np.log1p(r["every"])) for r in rows])
    model.curve = tuple(_logistic(x, np.array([float(r["toxic"]) for r in rows])))
    return model


def _scores(col, m: Model) -> np.ndarray:
    out = [m.probability(*m.document_evidence(data, off)[2:]) for _, _, data, off in sliced(col)]
    return np.concatenate(out) if out else np.zeros(0)


def score_documents(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input with ``score`` and ``predicted``, in place of columns of these
    names (map-only)."""
    src = df.drop("score", "predicted")
    names, at = src.columns, src.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most LEXICON units of 16 bytes
    schema = src.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            s = _scores(rb.column(at), shared.value)
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             [*names, "score", "predicted"])

    return src.mapInArrow(run, schema)


def keep_clean(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose text scores below one half; same columns (map-only)."""
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            yield rb.filter(pa.array(_scores(rb.column(at), shared.value) < 0.5))

    return df.mapInArrow(run, df.schema)
