"""Lineage through column metadata.

A scanned column is tagged with the table and column it came from. Catalyst
carries that metadata through renames, nesting, joins and group keys, and
drops it from every computed column, which is the safe direction: a value
that was computed is unknown, and unknown is denied.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

SRC = "veil.src"          # "table.column" the values were read from
SAFE = "veil.safe"        # a COUNT/SUM/AVG made by safe_agg
CHECKED = "veil.checked"  # computed from non-sensitive inputs only
MASKED = "veil.masked"    # already masked, with this action


def tag_source(df: DataFrame, table: str) -> DataFrame:
    """Tag every column as ``table.column``, replacing any earlier tag."""
    base = table.split(".")[-1].lower()
    reject_duplicates(df)
    return df.select(
        *[
            F.col(quoted(f.name)).alias(f.name, metadata={SRC: f"{base}.{f.name.lower()}"})
            for f in df.schema.fields
        ]
    )


def lineage_of(df: DataFrame) -> dict[str, str]:
    """Output column → ``table.column`` for every column still tagged."""
    return {f.name: f.metadata[SRC] for f in df.schema.fields if SRC in f.metadata}


def is_tagged(schema: T.StructType) -> bool:
    return any(SRC in f.metadata or SAFE in f.metadata for f in schema.fields)


def source_of(field: T.StructField) -> tuple[str | None, str]:
    """(table or None, lower-cased column) that governs this field."""
    src = field.metadata.get(SRC)
    if src is None:
        return None, field.name.lower()
    table, _, column = src.partition(".")
    return table, column


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def reject_duplicates(df: DataFrame) -> None:
    seen: set[str] = set()
    for name in df.columns:
        if name.lower() in seen:
            raise ValueError(f"duplicate output column {name!r}: rename it before masking")
        seen.add(name.lower())


def field_map(df: DataFrame) -> Mapping[str, T.StructField]:
    return {f.name.lower(): f for f in df.schema.fields}


def sensitive_outputs(df: DataFrame, sensitive: Iterable[str]) -> set[str]:
    """Lower-cased output names whose values come from a sensitive column."""
    listed = frozenset(sensitive)
    return {
        f.name.lower()
        for f in df.schema.fields
        if MASKED not in f.metadata and source_of(f)[1] in listed
    }
