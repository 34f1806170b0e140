"""Registry of named plans and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Plan:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, sql: str | None = None):
    def register(build):
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = Plan(name, build, sql)
        return build

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {p.name: p.build for p in PLANS.values()}


def oracle_sql() -> dict[str, str]:
    return {p.name: p.sql for p in PLANS.values() if p.sql}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project expressions written in SQL that both engines accept."""
    return df.selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()])


def derive_sql(source: str, columns: Mapping[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {source}"


def values_sql(rows: list[tuple], columns: list[str], name: str) -> str:
    """A VALUES list as a named relation."""

    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS {name}({', '.join(columns)})"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quote(v) for v in sorted(values)) + ")"
