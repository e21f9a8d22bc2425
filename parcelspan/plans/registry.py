"""The registry of queries: a name, the DataFrame that answers it, and the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from parcelspan.plans.inputs import Inputs
from parcelspan.plans.views import expand


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Inputs(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name of its own."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"two queries are named {name}")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def all_queries() -> dict[str, Query]:
    from parcelspan.plans import catalog  # noqa: F401  (registers everything)

    return dict(REGISTRY)


def all_sql() -> dict[str, str]:
    return {name: expand(q.sql) for name, q in all_queries().items() if q.sql}
