"""Named queries over the test tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(sql: str | None = None, **fill: str) -> Callable:
    """Register ``f(tables)`` under its name, with the SQL that gives the same rows; ``fill`` goes into its ``{name}``s."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            for k, v in fill.items():
                text = sql if k == next(iter(fill)) else ORACLES[f.__name__]
                ORACLES[f.__name__] = text.replace("{" + k + "}", v)
            if not fill:
                ORACLES[f.__name__] = sql
        return f

    return register


from skein.plans import (  # noqa: E402  these register themselves
    aggregates,  # noqa: F401
    exports,  # noqa: F401
    filters,  # noqa: F401
    graphs,  # noqa: F401
    joins,  # noqa: F401
    ordered,  # noqa: F401
    paging,  # noqa: F401
    ranking,  # noqa: F401
    reducers,  # noqa: F401
    scans,  # noqa: F401
    sources_of_code,  # noqa: F401
    texts,  # noqa: F401
    traces,  # noqa: F401
)
