"""Registered queries: each Spark plan next to the SQL that must agree with it."""

from veilspark.plans import audits, governed, identity, masking, quality, querylog, scalars, sources, streams
from veilspark.plans.registry import PLANS, oracle_sql, queries

__all__ = [
    "PLANS",
    "audits",
    "governed",
    "identity",
    "masking",
    "oracle_sql",
    "quality",
    "queries",
    "querylog",
    "scalars",
    "sources",
    "streams",
]
