"""Governed reading of tables on Spark: masking, access checks, audit."""

from veilspark.errors import AccessDenied
from veilspark.functions.keys import TokenKeys
from veilspark.operators.governed import GovernedSession
from veilspark.operators.masking import apply_masking, masked_fields, token_join
from veilspark.operators.measures import Measure, safe_agg
from veilspark.operators.tags import lineage_of, tag_source
from veilspark.policy import MaskingPolicy, Role, RoleBook, Route, SourceCatalog

__all__ = [
    "AccessDenied",
    "GovernedSession",
    "MaskingPolicy",
    "Measure",
    "Role",
    "RoleBook",
    "Route",
    "SourceCatalog",
    "TokenKeys",
    "apply_masking",
    "lineage_of",
    "masked_fields",
    "safe_agg",
    "tag_source",
    "token_join",
]
