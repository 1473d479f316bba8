"""Text analysis (TXT-1 .. TXT-13).

Row-level work is built-in regex / array expressions (whole-stage codegen);
only NFKC and mark stripping run in a pandas UDF, and only for non-ASCII
rows. Corpus statistics are aggregates over rows; token statistics explode
the token arrays into a map-side-combined ``groupBy`` (a stopword holding a
third of all tokens costs one record per task). Whole texts are processed,
never prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.columns import q, text_columns
from tessera.functions.distinct import distinct_counts
from tessera.functions.util import spread, with_row
from tessera.operators.standardize import nfkc, strip_marks

# ---------------------------------------------------------------- fixed values
EN_STOPWORDS = ["the", "a", "is", "it", "an", "in", "and", "or", "for", "to", "of", "on", "with", "by",
                "at", "from"]
AR_STOPWORDS = ["من", "على", "عن", "هذا", "هذه", "الى", "في", "او", "و", "كما", "انه", "كانت", "كان",
                "هناك", "حتى", "اليوم"]
# Rule-based lexicon (entries repeat on purpose: a repeated entry counts again).
POSITIVE_WORDS = ["ممتاز", "جيد", "رائع", "حلو", "جميل", "سعيد", "ناجح", "سريع",
                  "نظيف", "مريح", "لطيف", "احترافي", "دقيق", "مفيد", "جودة", "عالية",
                  "ممتازة", "مشكور", "شكراً", "ممتاز", "جيد", "رائع", "حلو", "جميل"]
NEGATIVE_WORDS = ["سيء", "بطيء", "متأخر", "سيئ", "غالي", "رديء", "محبط", "فاشل",
                  "قديم", "متعب", "صعب", "مزعج", "خطأ", "مشكلة", "مشاكل", "مشكلة",
                  "سيئ", "بطيء", "متأخر", "غالي", "رديء", "محبط", "فاشل"]
# Arabic letter folding used by cleaning: أ إ آ -> ا, ى -> ي, ؤ -> و, ئ -> ي, ة -> ه
CLEAN_AR_FROM = "أإآىؤئة"
CLEAN_AR_TO = "ااايويه"

# Patterns (Unicode classes spelled out so Java and RE2 agree).
URL_RE = r"https?://[^\s]+|www\.[^\s]+"
EMAIL_RE = r"\b[\p{L}\p{N}_.\-]+@[\p{L}\p{N}_\-.]+\.[\p{L}\p{N}_]+\b"
MENTION_RE = r"@[\p{L}\p{N}_]+"
DIGITS_RE = r"\p{Nd}+"
TOKEN_RE = r"[\p{L}\p{N}]+"
SENTENCE_RE = r"[.!?؟]+"
ARABIC_RE = r"[\x{0600}-\x{06FF}]"
# What is not counted: one match for a run of such characters, not one for each counted.
NOT_LETTER_RE = r"\P{L}+"
NOT_LATIN_RE = r"[^A-Za-z]+"
NOT_ARABIC_RE = r"[^\x{0600}-\x{06FF}]+"
NOT_DIGIT_RE = r"\P{Nd}+"
NOT_SPECIAL_RE = r"[\p{L}\p{N}\s]+"

TEXT_MIN_ALPHA = 0.3
ROWS_LIMIT = 500000
CHARS_LIMIT = 50_000_000


def stopwords(language: str) -> list[str]:
    if language == "en":
        return EN_STOPWORDS
    if language == "ar":
        return AR_STOPWORDS
    return EN_STOPWORDS + AR_STOPWORDS


def left_without(c: Column, pattern: str) -> Column:
    """Characters that stay when the runs of ``pattern`` go."""
    return F.length(F.regexp_replace(c, pattern, ""))


# ------------------------------------------------------------------ TXT-1
def detect_metrics(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column over all non-null values: distinct values, mean
    length, mean letter share, mean distinct whitespace tokens, mean
    whitespace count; and whether it counts as free text."""
    cols = cols if cols is not None else text_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "position int, column string, is_text boolean")
    structs = []
    for i, c in enumerate(cols):
        x = q(c).cast("string")
        ln = F.length(x)
        alpha = F.when(ln > 0, left_without(x, NOT_LETTER_RE) / ln).otherwise(F.lit(0.0))
        toks = F.when(F.trim(x, F.lit(" \t\n\r\f\u000b")) == "", F.lit(0)).otherwise(
            F.size(F.array_distinct(F.split(F.trim(x, F.lit(" \t\n\r\f\u000b")), r"\s+"))))
        spaces = left_without(x, r"\S+")
        structs.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column"),
            F.avg(ln).alias("avg_length"),
            F.avg(F.when(x.isNotNull(), alpha)).alias("alpha_ratio"),
            F.avg(F.when(x.isNotNull(), toks)).alias("unique_tokens"),
            F.avg(F.when(x.isNotNull(), spaces)).alias("space_ratio")).alias(f"s{i}"))
    long = spread(df).agg(*structs).select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("r")) \
             .select("r.*")
    counts = distinct_counts(df, [q(c).cast("string") for c in cols])
    number = F.create_map(*[F.lit(x) for i, n in enumerate(counts) for x in (i, n)])
    long = long.withColumn("unique_values", number[F.col("position")].cast("long"))
    L, A, T, S = F.col("avg_length"), F.col("alpha_ratio"), F.col("unique_tokens"), F.col("space_ratio")
    skip = (F.col("unique_values") == 1) & (L < 20)
    rule = (((L >= 15) & (A >= 0.3)) | ((L >= 8) & (A >= 0.5) & (T >= 3)) | ((L >= 12) & (S >= 0.2) & (A >= 0.25)))
    return long.withColumn("is_text", F.coalesce(~skip & rule, F.lit(False)))


def detect_text_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    rows = detect_metrics(df, cols).filter("is_text").orderBy("position").collect()  # one row per column
    return [r["column"] for r in rows]


# ------------------------------------------------------------------ TXT-2
def language_counts(df: DataFrame, text_cols: list[str]) -> DataFrame:
    """Letter counts over all text columns and rows:
    Arabic-block characters, ASCII letters, other letters; and the language:
    Arabic > 0.7 ar, Latin > 0.7 en, both within 0.3..0.7 mixed, else unknown."""
    cols = text_cols
    def total(count):
        return sum((F.coalesce(F.sum(count(q(c))), F.lit(0)) for c in cols), F.lit(0))

    ar = total(lambda x: left_without(x, NOT_ARABIC_RE))
    la = total(lambda x: left_without(x, NOT_LATIN_RE))
    letters = total(lambda x: left_without(x, NOT_LETTER_RE))
    ar_letters = total(lambda x: left_without(F.regexp_replace(x, NOT_ARABIC_RE, ""), NOT_LETTER_RE))
    agg = spread(df).agg(ar.alias("arabic_chars"), la.alias("latin_chars"),
                         (letters - la - ar_letters).alias("other_alpha"))
    tot = F.col("arabic_chars") + F.col("latin_chars") + F.col("other_alpha")
    ar_r, la_r = F.col("arabic_chars") / tot, F.col("latin_chars") / tot
    lang = (F.when(tot == 0, "unknown").when(ar_r > 0.7, "ar").when(la_r > 0.7, "en")
             .when((ar_r >= 0.3) & (ar_r <= 0.7) & (la_r >= 0.3) & (la_r <= 0.7), "mixed").otherwise("unknown"))
    return agg.withColumn("language", lang)


def detect_language(df: DataFrame, text_cols: list[str]) -> str:
    if not text_cols:
        return "none"
    return language_counts(df, text_cols).first()["language"]


# ------------------------------------------------------------------ TXT-3
def text_volume(df: DataFrame, text_cols: list[str], rows_limit: int | None = None,
                chars_limit: int | None = None) -> DataFrame:
    """Rows and total characters; the basic-only plan applies only when the
    caller sets limits (the reference's single-machine limits are off by default)."""
    chars = sum((F.coalesce(F.sum(F.length(q(c))), F.lit(0)) for c in text_cols), F.lit(0))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), chars.cast("long").alias("total_chars"))
    over = F.lit(False)
    if rows_limit is not None:
        over = over | (F.col("rows") > rows_limit)
    if chars_limit is not None:
        over = over | (F.col("total_chars") > chars_limit)
    return agg.withColumn("basic_only", over)


# ------------------------------------------------------------------ TXT-4
def clean_text(c: Column, language: str) -> Column:
    """URLs, e-mails, @mentions -> space; lower (en, mixed); Arabic fold and
    combining marks removed (ar, mixed); NFKC; digit runs -> space; squeeze
    whitespace and trim. Null -> ''."""
    x = F.coalesce(c.cast("string"), F.lit(""))
    # cheap literal guards keep the backtracking patterns off texts that
    # cannot match (no '@', no 'http' / 'www.')
    x = F.when(x.contains("http") | x.contains("www."), F.regexp_replace(x, URL_RE, " ")).otherwise(x)
    x = F.when(x.contains("@"), F.regexp_replace(F.regexp_replace(x, EMAIL_RE, " "), MENTION_RE, " ")).otherwise(x)
    if language in ("en", "mixed"):
        x = F.lower(x)
    if language in ("ar", "mixed"):
        x = strip_marks(F.translate(x, CLEAN_AR_FROM, CLEAN_AR_TO))
    x = nfkc(x)
    x = F.regexp_replace(x, DIGITS_RE, " ")
    x = F.regexp_replace(x, r"\s{2,}|[^\S ]", " ")  # a single blank stays as it is
    return F.trim(x)


# ------------------------------------------------------------------ TXT-5
def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN_RE), 0)


# ------------------------------------------------------------------ TXT-6
def token_counts(df: DataFrame, cleaned: Column) -> DataFrame:
    """(token, count) over all rows, written once: the texts are cleaned and cut once
    for every figure on tokens."""
    return (spread(df).select(F.explode(tokenize(cleaned)).alias("token"))
            .groupBy("token").agg(F.count(F.lit(1)).alias("count")).checkpoint())


def basic_features(df: DataFrame, col: str, language: str, cleaned: Column | None = None,
                   counts: DataFrame | None = None) -> DataFrame:
    """Corpus features of one text column: characters from the raw text in one
    pass over the rows, token figures from the counts per token of the cleaned
    text (``token_counts``; made here when not given)."""
    raw = q(col).cast("string")
    clean = cleaned if cleaned is not None else clean_text(raw, language)
    counts = counts if counts is not None else token_counts(df, clean)
    stop = F.array(*[F.lit(w) for w in stopwords(language)])
    r, n = F.col("_raw"), F.col("count")
    rows = spread(df.select(raw.alias("_raw"))).select(
        F.length(r).alias("_len"),
        F.when(r.isNotNull(), F.greatest(F.lit(1), F.regexp_count(r, F.lit(SENTENCE_RE)))).alias("_sent"),
        left_without(r, NOT_DIGIT_RE).alias("_dig"), left_without(r, NOT_SPECIAL_RE).alias("_spec"),
        left_without(r, NOT_ARABIC_RE).alias("_ar"))
    measures = rows.agg(
        F.avg("_len").alias("avg_len"), F.max("_len").alias("max_length"),
        F.min("_len").alias("min_length"), F.sum("_len").alias("chars"),
        F.count(F.lit(1)).alias("rows"), F.avg("_sent").alias("avg_sent"),
        F.sum("_dig").alias("digits"), F.sum("_spec").alias("special"), F.sum("_ar").alias("arabic"))
    agg = with_row(measures, counts.agg(
        F.sum(n).alias("tokens"), F.sum(n * F.length("token")).alias("tok_chars"),
        F.sum(F.when(F.array_contains(stop, F.col("token")), n).otherwise(0)).alias("stop"),
        F.count(F.lit(1)).alias("unique_tokens")))
    chars, toks = F.col("chars"), F.col("tokens")
    return agg.select(
        F.lit(col).alias("column"),
        F.round("avg_len", 2).alias("avg_length_chars"),
        F.round(F.when(toks > 0, toks / F.col("rows")).otherwise(0.0), 2).alias("avg_length_words"),
        F.round("avg_sent", 2).alias("avg_length_sentences"),
        F.col("max_length").cast("long").alias("max_length"), F.col("min_length").cast("long").alias("min_length"),
        F.round(F.when(chars > 0, F.col("digits") / chars).otherwise(0.0), 4).alias("numeric_ratio"),
        F.round(F.when(chars > 0, F.col("special") / chars).otherwise(0.0), 4).alias("special_char_ratio"),
        F.round(F.when(chars > 0, F.col("arabic") / chars).otherwise(0.0), 4).alias("arabic_ratio"),
        F.round(F.when(toks > 0, F.col("unique_tokens") / toks).otherwise(0.0), 4).alias("unique_token_ratio"),
        F.round(F.when(toks > 0, F.col("tok_chars") / toks).otherwise(0.0), 2).alias("avg_word_length"),
        F.round(F.when(toks > 0, F.col("stop") / toks).otherwise(0.0), 4).alias("stopword_ratio"))


# ------------------------------------------------------------- TXT-8 / 9
def top_tokens(df: DataFrame, cleaned: Column, language: str, k: int = 10,
               counts: DataFrame | None = None) -> DataFrame:
    """Tokens that are not stopwords and longer than one character: top k
    by count (ties: token ascending), with the total kept."""
    stop = F.array(*[F.lit(w) for w in stopwords(language)])
    counts = counts if counts is not None else token_counts(df, cleaned)  # the texts are read once for total and top
    kept = counts.filter(~F.array_contains(stop, F.col("token")) & (F.length("token") > 1))
    total = kept.agg(F.sum("count").alias("total_tokens"))
    top = kept.orderBy(F.desc("count"), "token").limit(k)  # per-task top-k, then merge
    return with_row(top, total)


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of an array column, as 'a b' strings (zip of the array
    with itself shifted by one; linear in the array length)."""
    n = F.size(tokens)
    pairs = F.arrays_zip(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                         F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.when(n >= 2, F.transform(pairs, lambda z: F.concat(z["a"], F.lit(" "), z["b"]))) \
            .otherwise(F.array().cast("array<string>"))


def top_bigrams(df: DataFrame, cleaned: Column, language: str, k: int = 10) -> DataFrame:
    """Bigrams after removing stopwords (short tokens stay): top k."""
    stop = F.array(*[F.lit(w) for w in stopwords(language)])
    # tokens become a column first: a lambda may not wrap a Python UDF, and
    # the filtered array is computed once per row, not once per element
    toks = spread(df).select(tokenize(cleaned).alias("_tok"))
    kept = toks.select(F.filter(F.col("_tok"), lambda t: ~F.array_contains(stop, t)).alias("_kept"))
    bg = kept.select(F.explode(bigrams(F.col("_kept"))).alias("bigram"))
    return bg.groupBy("bigram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "bigram").limit(k)


# ----------------------------------------------------------- TXT-10 .. 12
def lexicon_score(c: Column, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> Column:
    """+1 / -1 / 0 by more positive or negative list entries found as
    substrings of the lower-cased text (repeated entries count again)."""
    t = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    pos = sum((t.contains(w).cast("int") for w in positive), F.lit(0))
    neg = sum((t.contains(w).cast("int") for w in negative), F.lit(0))
    return F.signum(pos - neg).cast("int")


def _shares(scores: DataFrame, method: str, pos_cut: float = 0.0, neg_cut: float = 0.0) -> DataFrame:
    s = F.col("score")
    n = F.count(F.lit(1))
    return scores.agg(
        F.round(F.count_if(s > pos_cut) / n, 4).alias("positive_ratio"),
        F.round(F.count_if((s >= neg_cut) & (s <= pos_cut)) / n, 4).alias("neutral_ratio"),
        F.round(F.count_if(s < neg_cut) / n, 4).alias("negative_ratio"),
        F.round(F.avg(s), 4).alias("avg_sentiment_score")).withColumn("method_used", F.lit(method))


def sentiment_rule_based(df: DataFrame, cleaned: Column) -> DataFrame:
    return _shares(spread(df).select(lexicon_score(cleaned).alias("score")), "Arabic_RuleBased")


def sentiment_weighted(df: DataFrame, key_cols: list[str], cleaned: Column, lexicon: DataFrame,
                       alpha: float = 15.0, lexicon_rows_max: int = 1_000_000) -> DataFrame:
    """Per row: s = sum of valences of its tokens found in the lexicon
    (token, valence); compound = s / sqrt(s^2 + alpha); > 0.05 positive,
    < -0.05 negative. The lexicon is broadcast only under a checked size."""
    lex = lexicon.select(F.col("token").alias("_tk"), F.col("valence").cast("double").alias("_val"))
    if lexicon.count() <= lexicon_rows_max:
        lex = F.broadcast(lex)
    toks = spread(df).select(*[q(k) for k in key_cols], F.explode_outer(tokenize(cleaned)).alias("_t"))
    per_row = (toks.join(lex, F.col("_t") == F.col("_tk"), "left")
                   .groupBy(*key_cols).agg(F.coalesce(F.sum("_val"), F.lit(0.0)).alias("_s")))
    s = F.col("_s")
    scored = per_row.select(*key_cols, (s / F.sqrt(s * s + alpha)).alias("score"))
    return scored


def sentiment_weighted_summary(scored: DataFrame) -> DataFrame:
    return _shares(scored, "Weighted_Lexicon", 0.05, -0.05)


def sentiment_mixed(weighted: DataFrame, rule: DataFrame) -> DataFrame:
    """Mean of the two summaries (both one-row frames)."""
    b = rule.select([F.col(c).alias("b_" + c) for c in rule.columns])
    j = with_row(weighted.select([F.col(c).alias("a_" + c) for c in weighted.columns]), b)
    return j.select(*[F.round((F.col("a_" + c) + F.col("b_" + c)) / 2, 4).alias(c)
                      for c in ("positive_ratio", "neutral_ratio", "negative_ratio", "avg_sentiment_score")],
                    F.lit("Mixed_Weighted_RuleBased").alias("method_used"))


# ------------------------------------------------------------------ TXT-13
def text_report(df: DataFrame, lexicon: DataFrame | None = None, rows_limit: int | None = None,
                chars_limit: int | None = None) -> dict[str, DataFrame | str | list]:
    """Detection, language, volume, features, keywords and sentiment per
    text column; status skipped (no text column), partial (basic only) or completed."""
    cols = detect_text_columns(df)
    if not cols:
        return {"status": "skipped", "text_columns": []}
    lang = detect_language(df, cols)
    vol = text_volume(df, cols, rows_limit, chars_limit)
    basic_only = vol.first()["basic_only"]
    out: dict = {"text_columns": cols, "language": lang, "volume": vol}
    for c in cols:
        cl = clean_text(q(c), lang)
        counts = token_counts(df, cl)
        out[f"features:{c}"] = basic_features(df, c, lang, cl, counts)
        out[f"tokens:{c}"] = top_tokens(df, cl, lang, counts=counts)
        out[f"bigrams:{c}"] = top_bigrams(df, cl, lang)
        if not basic_only:
            out[f"sentiment:{c}"] = sentiment_rule_based(df, cl)
    out["status"] = "partial" if basic_only else "completed"
    return out
