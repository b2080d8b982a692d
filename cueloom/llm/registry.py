"""Queries of this subpackage: name -> (Spark plan, DuckDB SQL or None)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cueloom.shared import ship

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        @functools.wraps(plan)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plan(spark, sf_dir)

        PLANS[name] = shipped
        if sql is not None:
            SQL[name] = sql
        return shipped

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
