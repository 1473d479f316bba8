"""Named queries over the driver tables: each is a Spark plan plus, where the
semantics are SQL-expressible, the equivalent DuckDB SQL used as an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def load_all():
    """Import every catalogue module so its queries register."""
    import importlib
    import pkgutil

    from tessera.plans import catalog
    for m in pkgutil.iter_modules(catalog.__path__):
        importlib.import_module(f"tessera.plans.catalog.{m.name}")
    return QUERIES, ORACLES
