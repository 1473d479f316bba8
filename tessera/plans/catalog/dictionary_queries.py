"""DIC-1 .. DIC-3 and DOM-1 .. DOM-4."""

from __future__ import annotations


from tessera.operators import dictionary as dic
from tessera.operators import domain as dom
from tessera.plans.catalog.fixtures import EVENTS_NULLS_SQL, events_nulls
from tessera.plans.registry import load, query

_DIC_ROW = """SELECT {i} AS position, '{c}' AS name, '{alias}' AS clean_name, '{dtype}' AS data_type,
  {sem} AS semantic_type, '{title}' AS description, nu AS unique_values, round(nu / n, 4) AS uniqueness_ratio,
  round(z * 100.0 / n, 2) AS missing_pct,
  CASE WHEN nu <= 1 THEN 'constant' WHEN ident THEN 'identifier' WHEN tgt THEN 'target_candidate'
       WHEN {sem} = 'datetime' THEN 'temporal' ELSE 'feature' END AS recommended_role,
  ident AS is_identifier, tgt AS is_target_candidate
FROM (SELECT *, NOT ident AND nu > 1 AND ({sem} = 'binary' OR (starts_with({sem}, 'categorical') AND nu <= 5)
                 OR {tkw}) AS tgt
      FROM (SELECT *, nu / n >= 0.9 OR ({ikw} AND {sem} IN ('categorical', 'numeric', 'datetime')) AS ident
            FROM (SELECT count(*) AS n, count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS nu,
                         count(DISTINCT {c}) AS dn, count(DISTINCT {low}) AS ln, count(*) - count({c}) AS z FROM ev)))"""

_EV_COLS = [("event_id", "bigint", "num"), ("ts", "timestamp_ntz", "dt"), ("user_id", "bigint", "num"),
            ("event_type", "string", "txt"), ("value", "double", "num"), ("props", "string", "txt")]


def _dic_sql():
    parts = []
    for i, (c, t, kind) in enumerate(_EV_COLS):
        sem = {"num": "(CASE WHEN dn <= 2 THEN 'binary' WHEN dn <= 10 THEN 'categorical_numeric' ELSE 'numeric' END)",
               "dt": "'datetime'",
               "txt": "(CASE WHEN ln = 2 THEN 'binary' ELSE 'categorical' END)"}[kind]
        low = f"lower({c})" if kind == "txt" else c
        ikw = "true" if any(k in c for k in dic.IDENTIFIER_KEYWORDS) else "false"
        tkw = "true" if any(k in c for k in dic.TARGET_KEYWORDS) else "false"
        parts.append(_DIC_ROW.format(i=i, c=c, alias=dic.clean_names([c])[0], dtype=t, sem=sem,
                                     title=dic.describe_name(c), low=low, ikw=ikw, tkw=tkw))
    return f"WITH {EVENTS_NULLS_SQL}\n" + "\nUNION ALL\n".join(parts)


@query("feature_dictionary", _dic_sql())
def feature_dictionary(spark, sf):
    return dic.feature_dictionary(events_nulls(spark, sf))


@query("high_missing_features", f"""
SELECT position, name, missing_pct FROM ({_dic_sql()})
WHERE missing_pct >= 20 AND recommended_role NOT IN ('identifier', 'constant')
ORDER BY position LIMIT 8
""")
def high_missing_features(spark, sf):
    return dic.high_missing_features(dic.feature_dictionary(events_nulls(spark, sf)))


# --------------------------------------------------------------------- DOM
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _catalog(spark, sf):
    return dom.column_catalog({t: load(spark, sf, t) for t in TABLES})


_CAT_SQL = """cat AS (SELECT table_name AS "table", lower(column_name) AS col FROM information_schema.columns
  WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                       'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')),
packs AS (SELECT * FROM (VALUES {packs}) AS p(domain, pack_order, expected)),
npk AS (SELECT domain, pack_order, count(*) AS n_expected FROM packs GROUP BY 1, 2),
ncat AS (SELECT "table", count(*) AS n_columns FROM cat GROUP BY 1),
m AS (SELECT "table", domain, count(DISTINCT expected) AS matched FROM cat JOIN packs ON col = expected GROUP BY 1, 2),
g AS (SELECT ncat."table", npk.domain, npk.pack_order, coalesce(matched, 0) AS matched, n_expected, n_columns
      FROM ncat CROSS JOIN npk LEFT JOIN m ON m."table" = ncat."table" AND m.domain = npk.domain)"""


def _packs_values():
    from tessera.functions.constants import DOMAIN_PACKS
    return ", ".join(f"('{d}', {k}, '{c}')" for k, (d, p) in enumerate(DOMAIN_PACKS.items())
                     for c in p["expected_columns"])


@query("domain_match", f"""
WITH {_CAT_SQL.format(packs=_packs_values())}
SELECT "table", domain, matched, n_expected, round(matched / n_expected, 3) AS match_pct,
       CASE WHEN matched / n_expected >= 0.7 THEN 'OK' WHEN matched / n_expected >= 0.3 THEN 'WARN'
            ELSE 'STOP' END AS status
FROM g
""")
def domain_match(spark, sf):
    return dom.compatibility(_catalog(spark, sf)).drop("matched_columns", "missing_columns")


@query("domain_suggest", f"""
WITH {_CAT_SQL.format(packs=_packs_values())},
s AS (SELECT "table", domain, round(0.5 * (matched / n_expected + matched / greatest(n_columns, 1)), 3) AS score,
             pack_order FROM g)
SELECT "table", domain, score, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, pack_order) AS rank FROM s
""")
def domain_suggest(spark, sf):
    return dom.suggest(_catalog(spark, sf))


@query("domain_keywords", """
WITH cat AS (SELECT table_name AS "table", lower(column_name) AS col FROM information_schema.columns
  WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                       'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations')),
kw AS (SELECT * FROM (VALUES """ + ", ".join(
    f"({i}, '{d}', '{k}')" for i, (d, ks) in enumerate(__import__(
        "tessera.functions.constants", fromlist=["DOMAIN_KEYWORDS"]).DOMAIN_KEYWORDS.items()) for k in ks) + """)
  AS k(prio, domain, keyword)),
sc AS (SELECT t."table", k.prio, k.domain,
              count(DISTINCT k.keyword) FILTER (WHERE contains(c.col, k.keyword)) AS score
       FROM (SELECT DISTINCT "table" FROM cat) t CROSS JOIN kw k LEFT JOIN cat c ON c."table" = t."table"
       GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY score DESC, prio) AS rn FROM sc)
SELECT "table", CASE WHEN score > 0 THEN domain ELSE 'generic' END AS domain, score FROM best WHERE rn = 1
""")
def domain_keywords(spark, sf):
    return dom.keyword_domain(_catalog(spark, sf))
