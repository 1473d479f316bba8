"""Reading raw files (SRC-1 .. SRC-5).

CSV parsing stays in Spark's reader: PERMISSIVE mode already pads short
rows with nulls and truncates long ones, and keeps the raw line of every
such row in a corrupt-record column, so repair counts come from the same
single scan (no text pass through Python).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.columns import q, sanitize_name, unique_names
from tessera.operators.quality import empty_columns

CORRUPT = "_corrupt_record"


def _fmt(path: str) -> str:
    low = path.lower().rstrip("/")
    for ext in ("csv", "parquet", "json"):
        if low.endswith("." + ext):
            return ext
    raise ValueError(f"unsupported file type: {path}")


def csv_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Header names (first line) via the CSV reader itself, all as text."""
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path).columns


def _csv_reader(spark: SparkSession, sep: str, header: bool = True):
    return (spark.read.option("header", header).option("sep", sep).option("inferSchema", False)
            .option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True))


def read_source(spark: SparkSession, path: str, fmt: str | None = None, sep: str = ",") -> DataFrame:
    """SRC-1: csv (header, all text), parquet or json by extension."""
    fmt = fmt or _fmt(path)
    if fmt == "csv":
        return _csv_reader(spark, sep).option("mode", "PERMISSIVE").csv(path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt == "json":
        return spark.read.json(path)
    raise ValueError(f"unsupported format {fmt}")


def read_csv_with_corrupt(spark: SparkSession, path: str, sep: str = ",",
                          names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """PERMISSIVE read keeping the raw text of mis-sized rows. ``names``
    gives the header for files written without one."""
    header = names or csv_header(spark, path, sep)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header] +
                          [T.StructField(CORRUPT, T.StringType())])
    df = (_csv_reader(spark, sep, header=names is None).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path))
    return df, header


def _token_count(raw, sep: str) -> F.Column:
    """Fields of a line: separators left once the quoted parts are gone, plus one."""
    bare = F.regexp_replace(raw, '"[^"]*"', "")
    return F.floor((F.length(bare) - F.length(F.replace(bare, F.lit(sep)))) / len(sep)) + 1


def _raw_line(header: list[str]) -> F.Column:
    """The corrupt-record column, tied to every data column: the parser flags
    mis-sized rows only when it parses the full width, whatever is selected
    later (and it refuses scans of the corrupt column alone)."""
    return F.concat(F.col(CORRUPT), *[F.substring(F.coalesce(q(c), F.lit("")), 1, 0) for c in header])


def read_csv_tolerant(spark: SparkSession, path: str, sep: str = ",",
                      names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-2: (good rows, rejected rows). Like skipping bad lines: a line with
    more fields than the header is rejected; a short line is kept, padded."""
    df, header = read_csv_with_corrupt(spark, path, sep, names)
    raw = _raw_line(header)
    too_long = raw.isNotNull() & (_token_count(raw, sep) > len(header))
    return df.filter(~too_long).drop(CORRUPT), df.filter(too_long).select(raw.alias("raw_line"))


def repair_csv(spark: SparkSession, path: str, sep: str = ",",
               names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-3: the header gives the width; long rows truncated, short rows
    padded with null, values trimmed, "" an escaped quote; then SRC-4.
    Returns (table, counts of repairs by reason)."""
    df, header = read_csv_with_corrupt(spark, path, sep, names)
    n = len(header)
    raw = _raw_line(header)
    tok = _token_count(raw, sep)
    reason = (F.when(raw.isNull(), "ok").when(tok > n, "truncated").when(tok < n, "padded").otherwise("malformed"))
    counts = df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    table = post_process(df.drop(CORRUPT))
    return table, counts


def post_process(df: DataFrame) -> DataFrame:
    """SRC-4: drop all-null rows and columns, strip names of newlines,
    suffix duplicate names _1, _2 ..."""
    out = df.na.drop(how="all")
    empty = empty_columns(out)
    keep = [c for c in out.columns if c not in empty]
    names = unique_names([str(c).strip().replace("\n", "").replace("\r", "") for c in keep])
    return out.select(*[q(c).alias(nm) for c, nm in zip(keep, names)])


def sanitize_columns(df: DataFrame) -> DataFrame:
    """SRC-5: sanitised names; collisions are suffixed instead of clashing."""
    names = unique_names([sanitize_name(c) for c in df.columns])
    return df.select(*[q(c).alias(nm) for c, nm in zip(df.columns, names)])
