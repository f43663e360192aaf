"""Registry of every query the package exposes to the driver.

Each entry is a callable (spark, sf_dir) -> DataFrame reading the driver's
tables; ``ORACLES`` holds the DuckDB text for the keys SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from askwell.plans.metrics import METRICS
from askwell.sources.tables import Tables
from askwell.sources.views import Views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Query, oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle is not None:
        ORACLES[name] = oracle


def _metric_query(m) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return m.plan(Views(Tables(spark, sf_dir)))

    run.__name__ = m.name
    return run


for _m in METRICS.values():
    register(_m.name, _metric_query(_m), _m.oracle)

# operator queries register themselves on import
from askwell.plans import operator_queries, scoring_queries  # noqa: E402,F401
