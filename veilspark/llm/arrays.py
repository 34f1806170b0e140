"""Running values over arrays, in DataFrame functions and about linear time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often or inside whatever lambda the body uses it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running values of a short, non-empty array; copies the array so far for every element."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.slice(values, 1, 1), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), x))))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """``[v1, op(v1, v2), ...]`` of an associative ``op``: chunks by themselves, then what came before each chunk."""

    def chunked(all_values: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(all_values), F.lit(_CHUNK))
        chunks = F.transform(starts, lambda at: _running(F.slice(all_values, at, F.lit(_CHUNK)), op))
        return let(chunks, joined)

    def joined(chunks: Column) -> Column:
        ends = _running(F.transform(chunks, lambda c: F.element_at(c, -1)), op)
        return let(ends, lambda before: F.flatten(F.transform(chunks, lambda c, k: shifted(c, k, before))))

    def shifted(chunk: Column, k: Column, before: Column) -> Column:
        return F.when(k == 0, chunk).otherwise(F.transform(chunk, lambda x: op(F.element_at(before, k), x)))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(chunked(v)))
