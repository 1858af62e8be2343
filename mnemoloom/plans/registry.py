"""The catalogue of registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from ..sources.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(views: str = "", sql: str | None = None):
    """Register a function as a query; `views` names the projections its SQL reads."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, path: str) -> DataFrame:
            return fn(tune(spark, path), path)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        text = with_views(views, sql) if sql and views else sql
        CATALOGUE[fn.__name__] = Query(fn.__name__, run, text)
        return fn

    return add
