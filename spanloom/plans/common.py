"""How a module of plans registers its queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words: Iterable[str]) -> str:
    """A list for SQL."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


class Queries:
    def __init__(self):
        self.plans: dict[str, Plan] = {}
        self.sql: dict[str, str] = {}

    def put(self, name: str, plan: Plan, sql: str | None = None) -> None:
        self.plans[name] = plan
        if sql:
            self.sql[name] = sql

    def add(self, sql: str | None = None) -> Callable[[Plan], Plan]:
        def keep(plan: Plan) -> Plan:
            self.put(plan.__name__, plan, sql)
            return plan

        return keep
