"""Registration of queries, and what their plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import money

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total(x: Column | str) -> Column:
    """An exact sum of money, as a double."""
    return F.sum(money(x)).cast("double")


def ntz(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("timestamp_ntz")


#: Rows of a fact that a task sorts, joins and groups by nearly unique keys, at most: a few hundred megabytes.
TASK_ROWS = 250_000


def dealt(rows: int, *sides: tuple[DataFrame, str], task_rows: int | None = None) -> list[DataFrame]:
    """The sides of a join, each in partitions of its key, as many as ``rows`` of the largest need; left to the session and AQE if its shuffle partitions are enough.

    A task's memory then stays the same when the tables grow and the session's number of partitions doesn't.
    """
    n = -(-rows // (task_rows or TASK_ROWS))
    if n <= int(sides[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return [df for df, _ in sides]
    return [df.repartition(n, key) for df, key in sides]
