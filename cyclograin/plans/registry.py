"""Registry of runnable queries, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cyclograin.functions import stable

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    fn: QueryFn
    sql: str | None
    rounded: tuple[str, ...] = field(default=())
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.fn(spark, sf_dir)
        return df.withColumns({c: stable(c, self.digits) for c in self.rounded})

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        if not self.rounded:
            return self.sql
        scale = float(10**self.digits)
        parts = ", ".join(
            f'floor("{c}" * {scale} + 0.50001) / {scale} AS "{c}"' for c in self.rounded
        )
        return f"SELECT * REPLACE ({parts}) FROM ({self.sql}) q"


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, rounded: str = "", digits: int = 6):
    """Register a query; ``rounded`` names the double columns compared after rounding."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(fn, sql, tuple(rounded.split()), digits)
        return fn

    return add
