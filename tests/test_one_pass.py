"""Work that is done once, wide counts, and nearest donors by null pattern."""

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessera.operators import assoc, impute, impute_models, signals, standardize, text


def counted(spark, n, schema, row):
    """(frame of n rows, accumulator of the rows made in all its passes)"""
    made = spark.sparkContext.accumulator(0)

    def rows(batches):
        import pandas as pd
        for pdf in batches:
            made.add(len(pdf))
            yield pd.DataFrame([row(int(i)) for i in pdf["id"]])

    return spark.range(0, n, 1, 2).mapInPandas(rows, schema), made


def test_degrees_of_freedom_beyond_an_int(spark):
    keys = spark.range(50_000).selectExpr("cast(id as string) a", "cast(id as string) b")
    assert assoc.chi_square_pairs(keys, with_p=False).first()["dof"] == 49_999 ** 2


def test_quantile_signals_make_their_table_once(spark):
    for signal in (signals.outlier_pct_iqr, signals.tail_quantiles):
        df, made = counted(spark, 500, "a double, b double", lambda i: {"a": float(i * i % 97), "b": float(i)})
        assert signal(df, ["a", "b"]).count() == (2 if signal is signals.outlier_pct_iqr else 4)
        assert made.value == 500


def test_correlation_report_ranks_without_the_table(spark):
    names = [f"x{j}" for j in range(7)]
    df, made = counted(spark, 200, ", ".join(f"{n} double" for n in names) + ", s string, t string",
                       lambda i: {**{n: float(i * (j + 3) % (41 + 7 * j)) for j, n in enumerate(names)}, "s": "ab"[i % 2], "t": "cde"[i % 3]})
    num, cat = assoc.pearson_pairs(df, names).count(), assoc.chi_square_pairs(df, ["s", "t"]).count()
    passes, made.value = made.value, 0
    out = assoc.correlation_report(df, names, ["s", "t"]).collect()
    assert (num, cat) == (21, 1) and len(out) == 22 and all(r["fdr_applied"] for r in out)
    assert made.value <= passes, (made.value, passes)


def test_validation_runs_once(spark, monkeypatch):
    calls, plain = [], impute.validate
    monkeypatch.setattr(impute, "validate", lambda *a: calls.append(1) or plain(*a))
    df = spark.range(400).selectExpr("id", "if(id % 7 = 0, null, cast(id % 50 as double)) v")
    res = impute.run_imputation(df)
    assert res.validation().count() == 1 and res.status() in ("PASS", "WARN", "STOP") and len(calls) == 1


def test_texts_are_normalised_in_slices(spark):
    seen = []

    def work(x):
        seen.append(x)
        return x.upper()

    texts = ["ab", None, "ç"] * 300
    assert standardize._mapped(pa.array(texts, pa.string()), work).to_pylist() == [x and x.upper() for x in texts] and len(seen) == 600
    assert standardize._mapped(pa.array([], pa.string()), work).to_pylist() == []
    df = spark.createDataFrame([("é",), (None,), ("plain",), ("بَ",)], "t string")
    assert [r[0] for r in df.select(standardize.nfc(df.t)).collect()] == ["é", None, "plain", "بَ"]
    assert [r[0] for r in df.select(standardize.strip_marks(df.t)).collect()] == ["e", None, "plain", "ب"]


def test_row_goes_to_the_tree_of_its_nulls():
    nan = np.nan
    X = np.array([[1, nan, 2], [nan, 1, 1], [nan, nan, 3], [nan, nan, nan]])
    assert impute_models._tree_of(X, [2, 3]).tolist() == [0, -1, 1, -1]
    assert impute_models._tree_of(X, [2, None]).tolist() == [0, 1, 1, -1]


@pytest.mark.parametrize("most", [8, 2])
def test_nearest_by_null_pattern(spark, monkeypatch, most):
    monkeypatch.setattr(impute_models, "MOST_TREES", most)
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 3))
    X[rng.random(X.shape) < 0.25] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(X)], "id int, a double, b double, c double")
    got = np.array([r[1:] for r in sorted(impute_models.knn_impute(df, ["a", "b", "c"], cell_rows=8).collect())], float)
    both = ~np.isnan(X)[:, None] & ~np.isnan(X)[None]
    gap = np.where(both, np.nan_to_num(X)[:, None] - np.nan_to_num(X)[None], 0.0)
    n = both.sum(2)
    dist = np.where(n > 0, (gap ** 2).sum(2) * 3 / np.maximum(n, 1), np.inf)
    want = X.copy()
    for i, j in np.argwhere(np.isnan(X)):
        has = np.flatnonzero(~np.isnan(X[:, j]) & np.isfinite(dist[i]))
        want[i, j] = X[has[np.argsort(dist[i, has], kind="stable")[:5]], j].mean() if len(has) else np.nanmean(X[:, j])
    assert np.allclose(got, want)


def test_text_report_cleans_and_cuts_a_text_once(spark):
    lines = ["The quick brown fox, no. 1!", "a b  c\tقال 12 ٣", "", "\u00a0x\n\ny🂡𝒜"]
    df, made = counted(spark, 200, "t string", lambda i: {"t": lines[i % 4] * (i + 1)})
    text.detect_text_columns(df)
    detect, made.value = made.value, 0
    rep = text.text_report(df)
    rep["features:t"].collect()
    # beside detection: language, volume, tokens, row measures
    assert made.value <= detect + 4 * 200, (made.value, detect)


def test_counts_by_runs_equal_counts_by_character(spark):
    df = spark.createDataFrame([("The Fox_1, ٣ قالَ؟",), ("",), (None,), ("\u00a0 \t\n𝒜🂡é e\u0301²½\u2028x",)], "t string")
    for left, one in ((text.NOT_LETTER_RE, r"\p{L}"), (text.NOT_LATIN_RE, "[A-Za-z]"), (text.NOT_ARABIC_RE, text.ARABIC_RE), (text.NOT_DIGIT_RE, r"\p{Nd}"),
                      (text.NOT_SPECIAL_RE, r"[^\p{L}\p{N}\s]"), (r"\S+", r"\s")):
        rows = df.select(text.left_without(df.t, left).alias("a"), F.regexp_count("t", F.lit(one)).alias("b")).collect()
        assert [r.a for r in rows] == [r.b for r in rows], one
