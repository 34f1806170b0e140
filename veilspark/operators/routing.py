"""Table name → data source → database, type and dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.policy import SourceCatalog


def source_column(table: Column, catalog: SourceCatalog) -> Column:
    """Data source of a table name: the first matching route decides.

    Routes are two literal maps from a stem to its position, looked up for the whole
    name and for each prefix length in use, so a list of any length is one projection,
    in batch and on streams.
    """
    name = F.lower(table)
    whole, prefixes = catalog.stems
    found = []
    if whole:
        found.append(F.try_element_at(_literal_map(whole), name))
    for n in catalog.prefix_lengths:
        stem = F.when(F.length(name) >= n, F.substring(name, 1, n))
        found.append(F.try_element_at(_literal_map({s: p for s, p in prefixes.items() if len(s) == n}), stem))
    if not found:
        return F.lit("default")
    sources = F.array(*[F.lit(r.datasource) for r in catalog.routes])
    first = found[0] if len(found) == 1 else F.least(*found)
    return F.coalesce(F.get(sources, first), F.lit("default"))


def _literal_map(positions: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in positions.items() for x in pair])


def database_column(source: Column, catalog: SourceCatalog) -> Column:
    out = F.lit("")
    for s in catalog.sources.values():
        out = F.when(source == s.name, F.lit(s.database)).otherwise(out)
    return out


def dialect_column(source: Column, catalog: SourceCatalog) -> Column:
    out = F.lit("mysql")
    for s in catalog.sources.values():
        out = F.when(source == s.name, F.lit(s.dialect)).otherwise(out)
    return out


def route_tables(tables: DataFrame, catalog: SourceCatalog, column: str = "table_name") -> DataFrame:
    """Add ``datasource`` and ``database`` to a frame of table names, by one projection."""
    routed = tables.withColumn("datasource", source_column(F.col(column), catalog))
    return routed.withColumn("database", database_column(F.col("datasource"), catalog))
