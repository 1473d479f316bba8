"""TXT-1 .. TXT-13 over documents and conversations (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.util import round_doubles, spread
from tessera.operators import text as tx
from tessera.plans.registry import load, query

_SP = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def _detect_row(i, c):
    return f"""SELECT {i} AS position, '{c}' AS "column", count(DISTINCT {c}) AS unique_values,
  round(avg(length({c})), 4) AS avg_length,
  round(avg(CASE WHEN length({c}) > 0 THEN length(regexp_replace({c}, '[^\\p{{L}}]', '', 'g')) / length({c}) ELSE 0.0 END), 4) AS alpha_ratio,
  round(avg(CASE WHEN trim({c}, {_SP}) = '' THEN 0 ELSE len(list_distinct(string_split_regex(trim({c}, {_SP}), '\\s+'))) END), 4) AS unique_tokens,
  round(avg(length(regexp_replace({c}, '[^\\s]', '', 'g'))), 4) AS space_ratio
FROM documents"""


def _detect_sql():
    body = "\nUNION ALL\n".join(_detect_row(i, c) for i, c in enumerate(["text", "lang", "source"]))
    return f"""SELECT *, NOT (unique_values = 1 AND avg_length < 20) AND (
  (avg_length >= 15 AND alpha_ratio >= 0.3) OR (avg_length >= 8 AND alpha_ratio >= 0.5 AND unique_tokens >= 3)
  OR (avg_length >= 12 AND space_ratio >= 0.2 AND alpha_ratio >= 0.25)) AS is_text FROM ({body})"""


@query("text_detect", _detect_sql())
def text_detect(spark, sf):
    return round_doubles(tx.detect_metrics(load(spark, sf, "documents"), ["text", "lang", "source"]), 4)


@query("text_language", """
SELECT sum(length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g'))) AS arabic_chars,
       sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS latin_chars,
       sum(length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) - sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g')))
         - sum(length(regexp_replace(text, '[^\\x{0600}-\\x{06FF}]', '', 'g'))) AS other_alpha,
       'en' AS language
FROM documents
""")
def text_language(spark, sf):
    return tx.language_counts(load(spark, sf, "documents"), ["text"])


@query("text_volume", """
SELECT count(*) AS rows, sum(length(text)) AS total_chars, false AS basic_only FROM documents
""")
def text_volume(spark, sf):
    return tx.text_volume(load(spark, sf, "documents"), ["text"])


def _clean_sql(col: str) -> str:
    x = col
    x = f"regexp_replace({x}, '{tx.URL_RE}', ' ', 'g')"
    x = f"regexp_replace({x}, '{tx.EMAIL_RE}', ' ', 'g')"
    x = f"regexp_replace({x}, '{tx.MENTION_RE}', ' ', 'g')"
    x = f"nfc_normalize(lower({x}))"
    x = f"regexp_replace({x}, '{tx.DIGITS_RE}', ' ', 'g')"
    x = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    return f"trim({x})"


@query("text_clean", f"SELECT doc_id, {_clean_sql('text')} AS text FROM documents")
def text_clean(spark, sf):
    dc = spread(load(spark, sf, "documents"))
    return dc.select("doc_id", tx.clean_text(F.col("text"), "en").alias("text"))


_TOK = f"regexp_extract_all(lower({_clean_sql('text')}), '{tx.TOKEN_RE}')"
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.EN_STOPWORDS) + "]"


@query("text_features", f"""
WITH d AS (SELECT text AS r, {_TOK} AS t FROM documents),
u AS (SELECT count(DISTINCT tok) AS unique_tokens FROM (SELECT unnest(t) AS tok FROM d)),
a AS (SELECT avg(length(r)) AS avg_len, max(length(r)) AS max_length, min(length(r)) AS min_length,
             sum(length(r)) AS chars, sum(len(t)) AS tokens, count(*) AS rows,
             avg(greatest(1, len(regexp_extract_all(r, '{tx.SENTENCE_RE}')))) AS avg_sent,
             sum(len(regexp_extract_all(r, '\\p{{Nd}}'))) AS digits,
             sum(len(regexp_extract_all(r, '[^\\p{{L}}\\p{{N}}\\s]'))) AS special,
             sum(len(regexp_extract_all(r, '{tx.ARABIC_RE}'))) AS arabic,
             sum(list_sum(list_transform(t, lambda x: length(x)))) AS tok_chars,
             sum(len(list_filter(t, lambda x: list_contains({_STOP}, x)))) AS stop FROM d)
SELECT 'text' AS "column", round(avg_len, 2) AS avg_length_chars, round(tokens / rows, 2) AS avg_length_words,
       round(avg_sent, 2) AS avg_length_sentences, max_length, min_length,
       round(digits / chars, 4) AS numeric_ratio, round(special / chars, 4) AS special_char_ratio,
       round(arabic / chars, 4) AS arabic_ratio, round(unique_tokens / tokens, 4) AS unique_token_ratio,
       round(tok_chars / tokens, 2) AS avg_word_length, round(stop / tokens, 4) AS stopword_ratio
FROM a, u
""")
def text_features(spark, sf):
    return tx.basic_features(load(spark, sf, "documents"), "text", "en")


@query("top_tokens", f"""
WITH k AS (SELECT tok AS token FROM (SELECT unnest({_TOK}) AS tok FROM documents)
           WHERE NOT list_contains({_STOP}, tok) AND length(tok) > 1),
c AS (SELECT token, count(*) AS count FROM k GROUP BY 1)
SELECT token, count, (SELECT sum(count) FROM c) AS total_tokens FROM c ORDER BY count DESC, token LIMIT 10
""")
def top_tokens(spark, sf):
    dc = load(spark, sf, "documents")
    return tx.top_tokens(dc, tx.clean_text(F.col("text"), "en"), "en")


@query("top_bigrams", f"""
WITH f AS (SELECT list_filter({_TOK}, lambda x: NOT list_contains({_STOP}, x)) AS t FROM documents),
b AS (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS bigram FROM f WHERE len(t) >= 2)
SELECT bigram, count(*) AS count FROM b GROUP BY 1 ORDER BY count DESC, bigram LIMIT 10
""")
def top_bigrams(spark, sf):
    dc = load(spark, sf, "documents")
    return tx.top_bigrams(dc, tx.clean_text(F.col("text"), "en"), "en")


def _lex_sql(words):
    return " + ".join(f"CAST(contains(lower(t), '{w}') AS INTEGER)" for w in words)


@query("sentiment_lexicon", f"""
WITH c AS (SELECT {_clean_sql('text')} AS t FROM conversations),
s AS (SELECT sign(({_lex_sql(tx.POSITIVE_WORDS)}) - ({_lex_sql(tx.NEGATIVE_WORDS)})) AS score FROM c)
SELECT round(count(*) FILTER (WHERE score > 0) / count(*), 4) AS positive_ratio,
       round(count(*) FILTER (WHERE score = 0) / count(*), 4) AS neutral_ratio,
       round(count(*) FILTER (WHERE score < 0) / count(*), 4) AS negative_ratio,
       round(avg(score), 4) AS avg_sentiment_score, 'Arabic_RuleBased' AS method_used
FROM s
""")
def sentiment_lexicon(spark, sf):
    cv = load(spark, sf, "conversations")
    return tx.sentiment_rule_based(cv, tx.clean_text(F.col("text"), "en"))


# A caller-supplied weighted lexicon (token, valence); the reference ships none.
LEXICON = [("good", 1.9), ("great", 3.1), ("thanks", 1.9), ("thank", 1.5), ("help", 1.7), ("happy", 2.7),
           ("sure", 1.3), ("bad", -2.5), ("wrong", -2.1), ("error", -1.7), ("problem", -1.7), ("sorry", -0.3),
           ("fail", -2.3), ("failed", -2.3)]


def _lexicon_sql():
    return "(VALUES " + ", ".join(f"('{t}', {v})" for t, v in LEXICON) + ") AS lex(token, valence)"


@query("sentiment_weighted", f"""
WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower({_clean_sql('text')}), '{tx.TOKEN_RE}') AS t FROM conversations),
e AS (SELECT conv_id, turn, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS tok FROM c),
s AS (SELECT conv_id, turn, coalesce(sum(valence), 0.0) AS s FROM e LEFT JOIN {_lexicon_sql()} ON tok = lex.token
      GROUP BY 1, 2)
SELECT conv_id, turn, round(s / sqrt(s * s + 15.0), 6) AS score FROM s
""")
def sentiment_weighted(spark, sf):
    cv = load(spark, sf, "conversations")
    lex = spark.createDataFrame(LEXICON, "token string, valence double")
    scored = tx.sentiment_weighted(cv, ["conv_id", "turn"], tx.clean_text(F.col("text"), "en"), lex)
    return round_doubles(scored, 6)


def _summary_sql():
    lex_rule = f"""SELECT sign(({_lex_sql(tx.POSITIVE_WORDS)}) - ({_lex_sql(tx.NEGATIVE_WORDS)})) AS score
  FROM (SELECT {_clean_sql('text')} AS t FROM conversations)"""
    return f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower({_clean_sql('text')}), '{tx.TOKEN_RE}') AS t
               FROM conversations),
e AS (SELECT conv_id, turn, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS tok FROM c),
s AS (SELECT conv_id, turn, coalesce(sum(valence), 0.0) AS s FROM e LEFT JOIN {_lexicon_sql()} ON tok = lex.token
      GROUP BY 1, 2),
w AS (SELECT s / sqrt(s * s + 15.0) AS score FROM s),
ws AS (SELECT round(count(*) FILTER (WHERE score > 0.05) / count(*), 4) AS positive_ratio,
              round(count(*) FILTER (WHERE score >= -0.05 AND score <= 0.05) / count(*), 4) AS neutral_ratio,
              round(count(*) FILTER (WHERE score < -0.05) / count(*), 4) AS negative_ratio,
              round(avg(score), 4) AS avg_sentiment_score, 'Weighted_Lexicon' AS method_used FROM w),
r AS ({lex_rule}),
rs AS (SELECT round(count(*) FILTER (WHERE score > 0) / count(*), 4) AS positive_ratio,
              round(count(*) FILTER (WHERE score = 0) / count(*), 4) AS neutral_ratio,
              round(count(*) FILTER (WHERE score < 0) / count(*), 4) AS negative_ratio,
              round(avg(score), 4) AS avg_sentiment_score, 'Arabic_RuleBased' AS method_used FROM r)
SELECT * FROM ws UNION ALL SELECT * FROM rs
UNION ALL SELECT round((ws.positive_ratio + rs.positive_ratio) / 2, 4), round((ws.neutral_ratio + rs.neutral_ratio) / 2, 4),
                 round((ws.negative_ratio + rs.negative_ratio) / 2, 4),
                 round((ws.avg_sentiment_score + rs.avg_sentiment_score) / 2, 4), 'Mixed_Weighted_RuleBased'
FROM ws, rs"""


@query("sentiment_weighted_summary", _summary_sql())
def sentiment_weighted_summary(spark, sf):
    cv = load(spark, sf, "conversations")
    lex = spark.createDataFrame(LEXICON, "token string, valence double")
    cl = tx.clean_text(F.col("text"), "en")
    w = tx.sentiment_weighted_summary(tx.sentiment_weighted(cv, ["conv_id", "turn"], cl, lex))
    r = tx.sentiment_rule_based(cv, cl)
    return w.unionByName(r).unionByName(tx.sentiment_mixed(w, r))


_FEAT_SQL = f"""
WITH d AS (SELECT text AS r, {_TOK} AS t FROM documents),
u AS (SELECT count(DISTINCT tok) AS unique_tokens FROM (SELECT unnest(t) AS tok FROM d)),
a AS (SELECT avg(length(r)) AS avg_len, max(length(r)) AS max_length, min(length(r)) AS min_length,
             sum(length(r)) AS chars, sum(len(t)) AS tokens, count(*) AS rows,
             avg(greatest(1, len(regexp_extract_all(r, '{tx.SENTENCE_RE}')))) AS avg_sent,
             sum(len(regexp_extract_all(r, '\\p{{Nd}}'))) AS digits,
             sum(len(regexp_extract_all(r, '[^\\p{{L}}\\p{{N}}\\s]'))) AS special,
             sum(len(regexp_extract_all(r, '{tx.ARABIC_RE}'))) AS arabic,
             sum(list_sum(list_transform(t, lambda x: length(x)))) AS tok_chars,
             sum(len(list_filter(t, lambda x: list_contains({_STOP}, x)))) AS stop FROM d)
SELECT 'text' AS "column", round(avg_len, 2) AS avg_length_chars, round(tokens / rows, 2) AS avg_length_words,
       round(avg_sent, 2) AS avg_length_sentences, max_length, min_length,
       round(digits / chars, 4) AS numeric_ratio, round(special / chars, 4) AS special_char_ratio,
       round(arabic / chars, 4) AS arabic_ratio, round(unique_tokens / tokens, 4) AS unique_token_ratio,
       round(tok_chars / tokens, 2) AS avg_word_length, round(stop / tokens, 4) AS stopword_ratio
FROM a, u
"""


@query("text_report", f"SELECT *, 'en' AS language, 'completed' AS status FROM ({_FEAT_SQL})")
def text_report(spark, sf):
    rep = tx.text_report(load(spark, sf, "documents"))
    feats = [v for k, v in rep.items() if k.startswith("features:")]
    out = feats[0]
    for f in feats[1:]:
        out = out.unionByName(f)
    return out.withColumn("language", F.lit(rep["language"])).withColumn("status", F.lit(rep["status"]))
