"""Registration of queries that take a Library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagloom.library import Library, oracle


def registry():
    """(queries, oracle SQL, decorator) of one module."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None, *ctes: str, recursive: bool = False):
        def register(fn):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return fn(Library(spark, sf_dir))

            run.__doc__ = fn.__doc__
            queries[name] = run
            if sql is not None:
                oracles[name] = oracle(sql, *ctes, recursive=recursive)
            return fn

        return register

    return queries, oracles, query
