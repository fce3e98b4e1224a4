"""All queries of the core, and the session settings they rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.plans import fullpath, problems, reshape
from logloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "scan_project_flatten"


def _prepare(q: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return q(spark, sf)

    run.__name__ = getattr(q, "__name__", "query")
    run.__doc__ = q.__doc__
    return run


def prepared(qs: dict[str, Query]) -> dict[str, Query]:
    return {k: _prepare(q) for k, q in qs.items()}


def queries() -> dict[str, Query]:
    return prepared(reshape.QUERIES | fullpath.QUERIES | problems.QUERIES)


def sql() -> dict[str, str]:
    return reshape.SQL | fullpath.SQL | problems.SQL
