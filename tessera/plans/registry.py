"""All queries of the reference's operators and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a binding of an operator to the driver's tables, with the SQL that must give the same rows."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c: str) -> F.Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def days(c: str) -> F.Column:
    """Days since 1970 of a timestamp without zone."""
    return F.expr(f"cast(datediff(cast({c} as date), date'1970-01-01') as bigint)")


for _module in ("binning", "joining", "aggregating", "windowing", "sequences", "graphs", "variants", "alignments", "phasing", "regions", "streams"):
    import_module(f"tessera.plans.{_module}")
