"""The register of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CTES, Fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None, build: Callable[[Fixtures], DataFrame]) -> None:
    """Registers a query over the fixtures of a folder, and its SQL, which may use the fixtures by name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Fixtures(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run
    if sql:
        head, _, rest = sql.strip().partition(" ")
        SQL[name] = f"WITH RECURSIVE {CTES}, {rest}" if head == "WITH" else f"WITH {CTES} {sql}"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """df with the named columns rounded, so that the order of additions doesn't show."""
    return df.withColumns({n: F.round(n, digits) for n in names})
