"""Names of queries, the functions behind them, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..model import Archive
from ..session import ship
from . import derive

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, prefix: str = derive.SQL):
    """Registers f(spark, sf_dir). sql is what follows the derived relations: more of them, each after a comma, then a SELECT."""

    def register(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        if name in QUERIES:
            raise ValueError(f"{name} is registered already")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = prefix + sql
        return f

    return register


def on_archive(name: str, sql: str | None = None):
    """Registers f(archive) over the derived archive."""

    def register(f: Callable[[Archive], DataFrame]):
        query(name, sql)(lambda spark, sf_dir: f(derive.archive(spark, sf_dir)))
        return f

    return register
