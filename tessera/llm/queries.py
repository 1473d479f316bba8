"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (credentials, debruijn, mixing, ngram_trie, packing, phrases, repetition, sharding, sigtree, simhash, suffix_levels,
                         toxicity, turns)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op1_phrases")
def op1_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.edit_pairs(documents(spark, sf_dir))


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 40)


@query("op3_repetition")
def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.quality_rules(documents(spark, sf_dir))


@query("op4_mixing", """
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1)::INT] AS weight
      FROM d GROUP BY source),
r AS (SELECT *, sum(source_size) OVER () AS total,
             coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(weight) OVER (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
l AS (SELECT arg_min((total - 3 * held) / free, source_size / weight) FILTER (WHERE (total - 3 * held) / free <= 3 * source_size / weight) AS level FROM r),
t AS (SELECT source, source_size, least(weight * level, 3 * source_size) AS target FROM s, l),
u AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixing.with_copies(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return m.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"),
                    F.round("__mix_target", 6).alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).cast("long").alias("taken"))


@query("op5_suffix_levels")
def op5_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_levels.remove_repeats(documents(spark, sf_dir))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return (toxicity.score_documents(docs, model)
            .select("doc_id", F.coalesce(~toxicity.in_training(), F.lit(False)).alias("held_out"), "score", "predicted"))


@query("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@query("op8_ngram_trie")
def op8_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_documents(documents(spark, sf_dir))


@query("op9_sigtree")
def op9_sigtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.similar_groups(documents(spark, sf_dir))


@query("op10_credentials")
def op10_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.secret_digest(documents(spark, sf_dir))


@query("op13_turns")
def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(table(spark, sf_dir, "conversations"), damaged=True)


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.similar_groups(documents(spark, sf_dir))


@query("op11_collocations", r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
spot AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM spot GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer
           FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * f),
cuts AS (SELECT lang, phrase, f, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, cut, p.f AS l, q.f AS r, ((2000000::HUGEINT * cuts.f) // (p.f::HUGEINT + q.f))::BIGINT AS score
      FROM cuts JOIN f p ON p.lang = cuts.lang AND p.phrase = x JOIN f q ON q.lang = cuts.lang AND q.phrase = y),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE best = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.collocations(documents(spark, sf_dir))
