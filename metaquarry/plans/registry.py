"""Registry of runnable queries and of the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaquarry.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` reads the tables of a data folder."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: _run(fn, spark, sf_dir)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return fn(Tables(spark, sf_dir))


class Tables:
    """``t.documents`` is the documents table of the data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
