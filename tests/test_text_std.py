from pyspark.sql import functions as F

from tessera.operators import standardize as std
from tessera.operators import text as tx
from tessera.operators.features import feature_draft


def test_clean_tokenize_bigrams(spark):
    df = spark.createDataFrame([("Visit https://x.io or mail a.b@c.com, @bob! Order 123 ARRIVED late.",)], "t string")
    r = df.select(tx.clean_text(F.col("t"), "en").alias("c")).first().c
    assert r == "visit or mail , ! order arrived late."
    toks = df.select(tx.tokenize(F.lit(r)).alias("k")).first().k
    assert toks == ["visit", "or", "mail", "order", "arrived", "late"]
    bg = df.select(tx.bigrams(F.array(*[F.lit(x) for x in ["a", "b", "c"]])).alias("b")).first().b
    assert bg == ["a b", "b c"]


def test_top_tokens_exclude_stopwords(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("a cat",)], "t string")
    out = tx.top_tokens(df, tx.clean_text(F.col("t"), "en"), "en").collect()
    assert out[0].token == "cat" and out[0]["count"] == 2 and out[0].total_tokens == 3


def test_rule_based_sentiment_counts_repeats(spark):
    df = spark.createDataFrame([("ممتاز جدا",), ("سيء",), ("عادي",)], "t string")
    r = tx.sentiment_rule_based(df, F.col("t")).first()
    assert (r.positive_ratio, r.negative_ratio, r.neutral_ratio) == (0.3333, 0.3333, 0.3333)


def test_detection_rules(spark):
    df = spark.createDataFrame([("This is a long free text note about delivery", "OK", 1)] * 5,
                               "note string, code string, n int")
    assert tx.detect_text_columns(df) == ["note"]


def test_arabic_fold_and_maps(spark):
    df = spark.createDataFrame([("أحمد إلى مدرسة", "dhl"), ("آخر", "DHL Express"), ("x", "ARAMEX")],
                               "text_col string, carrier string")
    out = std.apply_domain_maps(std.normalize_text(df, ["text_col"]), "logistics").collect()
    assert out[0].text_col == "احمد الي مدرسه"
    assert [r.carrier for r in out] == ["DHL", "DHL", "Aramex"]


def test_collapse_rare_small_table_threshold(spark):
    rows = [("A",)] * 95 + [("B",)] * 3 + [("C",)] * 2
    out, rep = std.collapse_rare(spark.createDataFrame(rows, "category string"), ["category"])
    assert rep.first().n_collapsed == 2
    assert sorted(set(r.category for r in out.collect())) == ["A", "Other"]


def test_feature_caps_and_sla_boundary(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0, t0 + dt.timedelta(hours=h), "Returned" if h == 300 else "Delivered") for h in (24, 48, 72, 300, 500)]
    df = spark.createDataFrame(rows, "pickup_date timestamp_ntz, delivery_date timestamp_ntz, status string")
    out, specs, caps = feature_draft(df, "logistics")
    vals = sorted((r.transit_time, r.sla_flag, r.rto_flag) for r in out.collect())
    assert vals == [(24.0, 1, 0), (48.0, 1, 0), (72.0, 0, 0), (240.0, 0, 0), (240.0, 0, 1)]
    assert caps.first().n_capped == 2
    assert {r.name: r.capped for r in specs.collect()}["transit_time"] is True
