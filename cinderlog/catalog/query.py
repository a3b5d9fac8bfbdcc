from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from cinderlog.session import configure


@dataclass(frozen=True)
class Query:
    """A query over the tables of a folder, and the SQL that must give the same rows."""

    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.run(configure(spark), sf_dir)


def with_ctes(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select.strip()}"
