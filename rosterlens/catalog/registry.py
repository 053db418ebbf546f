"""The named queries: each a function of the views, most with the same result as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, with_views

_RUN: dict[str, Callable[[Views], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; with SQL, its result is compared with that SQL's."""

    def keep(run):
        assert name not in _RUN, name
        _RUN[name] = run
        if sql is not None:
            _SQL[name] = with_views(sql)
        return run

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show; -0.0 becomes 0.0."""
    return df.select(*[
        (F.round(c, digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes])


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import load

    load()
    return {n: (lambda spark, folder, f=f: f(Views(spark, folder))) for n, f in _RUN.items()}


def all_sql() -> dict[str, str]:
    from . import load

    load()
    return dict(_SQL)
