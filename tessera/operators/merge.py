"""Key-checked left merging (MRG-1 .. MRG-6).

* Duplicate policy (MRG-2): share of rows beyond the first per key; keeping
  the latest row per key is a ``max_by`` aggregate, so a key holding a third
  of the rows is reduced map-side (partial aggregation) instead of being
  sorted inside one window task.
* Left equi-join (MRG-3): a plain ``join(..., "left")``; AQE picks broadcast
  only when the measured right side is small and splits skewed keys.
* Orphans (MRG-4/5): counted from key columns only (left side keys joined to
  per-key counts of the right side), so the check never materialises the
  wide join; quarantine is a lazy ``left_anti`` / inner pair.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.columns import q

DUP_STOP, DUP_KEEP_LATEST = 0.10, 0.03
ORPHAN_STOP, ORPHAN_QUARANTINE = 0.10, 0.02

ISSUE_SCHEMA = "step int, table string, issue_type string, count long, percentage double, action string"


@dataclass
class MergeResult:
    data: DataFrame
    issues: DataFrame
    status: str
    orphans: dict[str, DataFrame] = field(default_factory=dict)
    tables_merged: list[str] = field(default_factory=list)


# ------------------------------------------------------------------ MRG-1
def choose_key(main_cols: list[str], other_cols: list[str], key: str | None = None) -> str | None:
    """Given key if in both tables, else the first common column (in the
    left table's order) whose name contains 'id'."""
    if key and key in main_cols and key in other_cols:
        return key
    other = set(other_cols)
    for c in main_cols:
        if c in other and "id" in c.lower():
            return c
    return None


def default_key(cols: list[str]) -> str | None:
    for c in cols:
        if "id" in c.lower():
            return c
    return None


def timestamp_like(cols: list[str]) -> str | None:
    """First column whose name contains date, time or ts."""
    for c in cols:
        lc = c.lower()
        if "date" in lc or "time" in lc or "ts" in lc:
            return c
    return None


# ------------------------------------------------------------------ MRG-2
def duplicate_stats(df: DataFrame, key: str) -> tuple[int, int]:
    """(rows, rows beyond the first per key value, nulls equal). One aggregate."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(q(key)).alias("d"),
               F.max(q(key).isNull().cast("int")).alias("z")).first()
    n = r["n"] or 0
    return n, (n - (r["d"] or 0) - (r["z"] or 0)) if n else 0


def duplicate_action(pct: float) -> str | None:
    if pct <= 0:
        return None
    return "stopped" if pct > DUP_STOP else "kept_latest" if pct > DUP_KEEP_LATEST else "flagged"


def keep_latest(df: DataFrame, key: str, ts_col: str, tie_cols: list[str] | None = None) -> DataFrame:
    """One row per key: the latest ``ts_col`` (nulls lose), ties broken by the
    largest ``tie_cols`` (default: all other columns). The rank filter is planned
    as a group limit before the shuffle: a task sends one row per key."""
    cols = df.columns
    ties = tie_cols if tie_cols is not None else [c for c in cols if c not in (key, ts_col)]
    w = Window.partitionBy(q(key)).orderBy(*[q(c).desc_nulls_last() for c in (ts_col, *ties)])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*[q(c) for c in cols])


# ------------------------------------------------------------- MRG-3..6
def _issue(spark, step, table, kind, count, pct, action):
    return (step, table, kind, int(count), round(float(pct), 4), action)


def check_and_dedupe(df: DataFrame, table: str, key: str | None, step: int, issues: list) -> DataFrame:
    key = key or default_key(df.columns)
    if key is None:
        return df
    n, dups = duplicate_stats(df, key)
    pct = dups / n if n else 0.0
    action = duplicate_action(pct)
    if action is None:
        return df
    issues.append(_issue(df.sparkSession, step, table, "duplicates", dups, pct, action))
    ts = timestamp_like(df.columns)
    if pct <= DUP_STOP and ts:
        return keep_latest(df, key, ts)
    return df


@dataclass
class _Step:
    """One right table of a merge: its key, prepared columns and whether keys repeat."""
    number: int
    name: str
    key: str
    right: DataFrame
    repeats: bool


def _plan(main: DataFrame, tables: list, issues: list) -> list[_Step]:
    """Keys and renamed columns of every table that takes part; duplicates are
    checked on the key columns alone."""
    have, steps = list(main.columns), []
    for number, (name, other, hint) in enumerate(tables, start=1):
        key = choose_key(have, other.columns, hint)
        if key is None or other.isEmpty():
            continue
        before = len(issues)
        other = check_and_dedupe(other, name, key, number, issues)
        found = issues[before:]
        repeats = bool(found) and not (found[0][5] != "stopped" and timestamp_like(other.columns))
        rename = {c: (f"{c}_{name}" if c in have else c) for c in other.columns if c != key}
        steps.append(_Step(number, name, key, other.select(q(key).alias(key), *[q(c).alias(rename[c]) for c in other.columns if c != key]), repeats))
        have += [rename[c] for c in other.columns if c != key]
    return steps


def match_vectors(main: DataFrame, steps: list[_Step]) -> list[tuple[tuple, list[float]]]:
    """(which tables matched, rows after each step) for every combination of matches
    that occurs, from one chain of joins over the key columns alone. Where a later
    table repeats a key a row counts for its share of the rows that come of it."""
    needed = {s.key for s in steps}
    data = main.select(*[q(c) for c in main.columns if c in needed])
    for i, s in enumerate(steps):
        later = {t.key for t in steps[i + 1:]}
        right = s.right.select(q(s.key).alias("_k"), *[q(c) for c in s.right.columns if c != s.key and c in later], F.lit(1).alias(f"_m{i}"))
        if s.repeats:
            per_key = s.right.groupBy(q(s.key).alias("_kk")).agg(F.count(F.lit(1)).alias(f"_c{i}"))
            right = right.join(per_key, right["_k"] == per_key["_kk"]).drop("_kk")
        data = data.join(right, data[s.key] == right["_k"], "left").drop("_k")
    markers = [F.coalesce(F.col(f"_m{i}"), F.lit(0)).alias(f"_m{i}") for i in range(len(steps))]
    sums = []
    for i in range(len(steps)):
        share = F.lit(1.0)
        for j in range(i + 1, len(steps)):
            if steps[j].repeats:
                share = share / F.coalesce(F.col(f"_c{j}"), F.lit(1))
        sums.append(F.sum(share).alias(f"_w{i}"))
    rows = data.groupBy(*markers).agg(*sums).collect()  # at most 2 ** tables rows
    return [(tuple(r[f"_m{i}"] for i in range(len(steps))), [r[f"_w{i}"] for i in range(len(steps))]) for r in rows]


def merge_tables(main: DataFrame, tables: list[tuple[str, DataFrame, str | None]],
                 on_duplicates: str = "stop") -> MergeResult:
    """Left-merge each table in turn on its key; clashing right columns get
    the suffix ``_<table>``. Returns data, issue table, status and orphans. All
    orphan decisions come from one narrow chain of joins, grouped by which tables
    matched; the data's own joins are planned once."""
    spark = main.sparkSession
    issues: list[tuple] = []
    data = check_and_dedupe(main, "main", None, 0, issues)
    steps = _plan(data, tables, issues)
    vectors = match_vectors(data, steps) if steps else []
    orphans: dict[str, DataFrame] = {}
    for i, s in enumerate(steps):
        rows = round(sum(w[i] for _, w in vectors))
        orph = round(sum(w[i] for m, w in vectors if not m[i]))
        joined = data.join(s.right.withColumn("_matched", F.lit(True)), s.key, "left")
        pct = orph / rows if rows else 0.0
        if pct > 0:
            action = "stopped" if pct > ORPHAN_STOP else "quarantined" if pct > ORPHAN_QUARANTINE else "flagged"
            issues.append(_issue(spark, s.number, s.name, "orphans", orph, pct, action))
            if action == "quarantined":
                orphans[s.name] = joined.filter(F.col("_matched").isNull()).drop("_matched")
                joined = joined.filter(F.col("_matched").isNotNull())
                vectors = [v for v in vectors if v[0][i]]
        data = joined.drop("_matched")
    issues.sort(key=lambda x: x[0])
    actions = {i[5] for i in issues}
    status = "STOP" if "stopped" in actions else "WARN" if actions & {"quarantined", "kept_latest"} else "PASS"
    if status == "STOP" and on_duplicates == "warn" and any(i[2] == "duplicates" for i in issues):
        status = "WARN"
    return MergeResult(data, spark.createDataFrame(issues, ISSUE_SCHEMA), status, orphans, ["main", *[s.name for s in steps]])
