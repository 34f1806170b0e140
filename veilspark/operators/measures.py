"""Aggregates that may be shown: COUNT, SUM and AVG with numeric wrapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.operators.tags import SAFE, col

SAFE_FUNCTIONS = frozenset({"count", "sum", "avg"})


@dataclass(frozen=True)
class Measure:
    """One aggregate over at most one column, then numeric constants only.

    MIN and MAX can return a raw text value, so they are never safe.
    """

    func: str
    column: str | None = None
    scale: int | None = None
    factor: float | int | None = None
    offset: float | int | None = None
    distinct: bool = False
    divisor: Measure | None = None

    @classmethod
    def count(cls, column: str | None = None, distinct: bool = False) -> Measure:
        return cls("count", column, distinct=distinct)

    @classmethod
    def sum(cls, column: str) -> Measure:
        return cls("sum", column)

    @classmethod
    def avg(cls, column: str) -> Measure:
        return cls("avg", column)

    @classmethod
    def min(cls, column: str) -> Measure:
        return cls("min", column)

    @classmethod
    def max(cls, column: str) -> Measure:
        return cls("max", column)

    def rounded(self, scale: int) -> Measure:
        return replace(self, scale=scale)

    def times(self, factor: float | int) -> Measure:
        return replace(self, factor=factor)

    def plus(self, offset: float | int) -> Measure:
        return replace(self, offset=offset)

    def over(self, divisor: Measure) -> Measure:
        """A quotient of two aggregates, as a mean of sums that were pre-aggregated."""
        return replace(self, divisor=divisor)

    @property
    def safe(self) -> bool:
        return self.func in SAFE_FUNCTIONS and (self.divisor is None or self.divisor.safe)

    @property
    def columns(self) -> set[str]:
        own = {self.column} if self.column is not None else set()
        return own | (self.divisor.columns if self.divisor else set())

    def wrap(self, value: Column) -> Column:
        if self.factor is not None:
            value = value * F.lit(self.factor)
        if self.offset is not None:
            value = value + F.lit(self.offset)
        return F.round(value, self.scale) if self.scale is not None else value

    def aggregate(self) -> Column:
        if self.func == "count" and self.column is None:
            value = F.count(F.lit(1))
        elif self.func == "count":
            c = col(self.column)
            value = F.count_distinct(c) if self.distinct else F.count(c)
        else:
            build = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.func]
            value = build(col(self.column))
        return value / self.divisor.aggregate() if self.divisor else value

    def column_expr(self, name: str) -> Column:
        value = self.wrap(self.aggregate())
        return value.alias(name, metadata={SAFE: True}) if self.safe else value.alias(name)


def safe_agg(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Measure]
) -> DataFrame:
    """Group and aggregate; safe outputs are tagged so that masking lets them pass.

    Group keys keep their source tag, unsafe outputs carry none and are denied.
    """
    exprs = [m.column_expr(name) for name, m in measures.items()]
    return df.groupBy(*[col(k) for k in keys]).agg(*exprs)
