"""Verdicts after a change of policy: only queries that the change touches are judged again."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from veilspark.operators.querylog import query_verdict
from veilspark.policy import MaskingPolicy, RoleBook, SourceCatalog


@dataclass(frozen=True)
class Rules:
    """What verdicts follow from."""

    book: RoleBook
    policy: MaskingPolicy
    catalog: SourceCatalog


@dataclass(frozen=True)
class Change:
    """What differs between two sets of rules, in terms of what a query can touch."""

    everything: bool  # databases or routes differ
    roles: frozenset[str]  # a role came, went, or may do other things
    tables: dict[str, frozenset[str]]  # for a role, the tables it gained or lost
    large: frozenset[str]  # tables whose filters are judged otherwise
    columns: frozenset[str]  # columns that became or ceased to be sensitive


def change(old: Rules, new: Rules) -> Change:
    names = set(old.book.roles) | set(new.book.roles)
    roles, tables = set(), {}
    for name in names:
        before, after = old.book.roles.get(name), new.book.roles.get(name)
        if before is None or after is None:
            roles.add(name)
            continue
        if replace(before, allowed_tables=after.allowed_tables) != after:
            roles.add(name)
        if gained_or_lost := frozenset(before.allowed ^ after.allowed):
            tables[name] = gained_or_lost
    large = old.book.large_tables ^ new.book.large_tables
    if old.book.filter_columns != new.book.filter_columns:
        large = old.book.large_tables | new.book.large_tables
    routed = [(f.name, getattr(old.catalog, f.name) == getattr(new.catalog, f.name)) for f in fields(SourceCatalog)]
    return Change(
        not all(same for _, same in routed),
        frozenset(roles),
        tables,
        frozenset(large),
        frozenset(old.policy.sensitive_columns ^ new.policy.sensitive_columns),
    )


def touched_queries(log: DataFrame, refs: DataFrame, uses: DataFrame, what: Change) -> DataFrame:
    """``query_id`` of every query whose verdict may differ, once."""
    if what.everything:
        return log.select("query_id").distinct()
    found = [log.where(F.col("role").isin(sorted(what.roles))).select("query_id")]
    name = F.lower("table_name")
    if what.tables:
        listed = sorted(frozenset().union(*what.tables.values()))
        named = refs.where(name.isin(listed)).select("query_id", name.alias("name")).distinct()
        hit = reduce(or_, [(F.col("role") == r) & F.col("name").isin(sorted(t)) for r, t in what.tables.items()])
        found.append(named.join(log.select("query_id", "role"), "query_id").where(hit).select("query_id"))
    found.append(refs.where(name.isin(sorted(what.large))).select("query_id"))
    found.append(uses.where(F.lower("column_name").isin(sorted(what.columns))).select("query_id"))
    return reduce(DataFrame.union, found).distinct()


def rejudge(
    stored: DataFrame, log: DataFrame, shape: DataFrame, refs: DataFrame, uses: DataFrame, old: Rules, new: Rules
) -> DataFrame:
    """The verdicts of ``stored`` (made by :func:`query_verdict` under ``old``) as they are under ``new``.

    Queries that the change cannot touch keep their row; log and facts of the others are
    judged again. Equal to a full run under ``new``.
    """
    touched = touched_queries(log, refs, uses, change(old, new))
    again = [frame.join(touched, "query_id", "left_semi") for frame in (log, shape, refs, uses)]
    fresh = query_verdict(*again, new.book, new.policy, new.catalog)
    return stored.join(touched, "query_id", "left_anti").unionByName(fresh)
