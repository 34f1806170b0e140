"""Sources and sinks."""

from veilspark.sources.audit_log import AUDIT_SCHEMA, audit_layout, read_audit, write_audit
from veilspark.sources.policy_files import (
    expand_rules,
    load_policy,
    load_rules,
    override_rows,
    read_tokens,
    rule_entries,
    rule_rows,
)
from veilspark.sources.tables import (
    column_catalog,
    decimals_as_double,
    jdbc_options,
    param_query,
    read_source,
    routed_read,
)

__all__ = [
    "AUDIT_SCHEMA",
    "audit_layout",
    "column_catalog",
    "decimals_as_double",
    "expand_rules",
    "jdbc_options",
    "load_policy",
    "load_rules",
    "override_rows",
    "param_query",
    "read_audit",
    "read_source",
    "read_tokens",
    "routed_read",
    "rule_entries",
    "rule_rows",
    "write_audit",
]
