"""Registered queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_base import typed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, columns: str, sql: str | None = None, ctes: str = "") -> Callable[[Query], Query]:
    """Register a query under a name. `columns` fixes names and types of the result on both sides."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            frame = function(spark, directory)
            return frame.select(
                *[
                    F.col(c).cast("string" if t == "varchar" else t).alias(c)
                    for c, t in (pair.strip().rsplit(" ", 1) for pair in columns.split(","))
                ]
            )

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = typed((f"WITH {ctes}\n-- result\n" if ctes else "") + sql, columns)
        return function

    return register


def positions(frame: DataFrame) -> DataFrame:
    return frame.withColumnRenamed("start", "start_pos").withColumnRenamed("end", "end_pos")
