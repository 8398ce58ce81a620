"""The registry of named queries, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a directory, read when asked for: Tables(spark, dir).orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    """Register a function of Tables under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def lat_of(key: str) -> Column:
    """A stand-in latitude that both engines compute exactly."""
    return (F.col(key) * 7919 % 18000).cast("double") / 100.0 - 90.0


def lng_of(key: str) -> Column:
    return (F.col(key) * 104729 % 36000).cast("double") / 100.0 - 180.0


def sql_lat(key: str) -> str:
    return f"(CAST({key} * 7919 % 18000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(90 AS DOUBLE))"


def sql_lng(key: str) -> str:
    return f"(CAST({key} * 104729 % 36000 AS DOUBLE) / CAST(100 AS DOUBLE) - CAST(180 AS DOUBLE))"


def sql_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    h = f"(power(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin((radians({lng2}) - radians({lng1})) / 2), 2))"
    return f"(CAST(12742 AS DOUBLE) * asin(sqrt(least({h}, CAST(1 AS DOUBLE)))))"


def sql_places(x: str, n: int) -> str:
    return f"(floor(({x}) * CAST({10**n} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({10**n} AS DOUBLE))"


def joined(array: Column) -> Column:
    """An array as text, so that every engine hashes it alike."""
    return F.array_join(array, "|")
