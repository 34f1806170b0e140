"""Policy documents as small driver-side values.

Masking rules, roles, data sources and table routes are configuration: their
size is the size of a config file, never of the data. They are resolved once
here, so that plans only ever contain the decision and not the lookup.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import SparkSession

# Action names, the set that makes a column sensitive, dialects.
SENSITIVE_ACTIONS = frozenset({"tokenize", "deny", "mask_phone", "mask_email"})
DEFAULT_FILTER_COLUMNS = frozenset({"n_year", "n_period", "fyear", "fperiod"})
DIALECT_OF_TYPE = {
    "mysql": "mysql",
    "mariadb": "mysql",
    "sqlserver": "tsql",
    "mssql": "tsql",
    "postgresql": "postgres",
    "postgres": "postgres",
}
ROLE_RANK = {"viewer": 1, "developer": 2}

_STRICTNESS = {"passthrough": 0, "mask_email": 1, "mask_phone": 1, "tokenize": 2}


def strictness(action: str) -> int:
    """deny and any unlisted action null the value, so both rank highest."""
    return _STRICTNESS.get(action, 3)


@dataclass(frozen=True)
class ColumnRule:
    action: str
    namespace: str = ""
    prefix: str = ""


@dataclass(frozen=True)
class MaskingPolicy:
    """Column rules keyed by lower-cased column name."""

    rules: Mapping[str, ColumnRule]
    default_action: str = "deny"
    placeholders: tuple[str, ...] = ("",)
    overrides: Mapping[str, Mapping[str, str]] = field(default_factory=dict)

    @classmethod
    def from_document(cls, doc: Mapping) -> MaskingPolicy:
        rules: dict[str, ColumnRule] = {}
        for entry in doc.get("rules") or []:
            rule = ColumnRule(
                entry["action"], entry.get("namespace") or "", entry.get("prefix") or ""
            )
            for column in entry.get("columns") or []:
                rules[column.lower()] = rule  # the last rule for a column wins
        defaults = doc.get("defaults") or {}
        return cls(
            rules=rules,
            default_action=defaults.get("unknown_column", "deny"),
            placeholders=tuple(defaults.get("tokenizer_placeholders", [""])),
            overrides=doc.get("table_overrides") or {},
        )

    @cached_property
    def sensitive_columns(self) -> frozenset[str]:
        from_rules = {c for c, r in self.rules.items() if r.action in SENSITIVE_ACTIONS}
        from_overrides = {
            column.lower()
            for columns in self.overrides.values()
            for column, action in columns.items()
            if action in SENSITIVE_ACTIONS
        }
        return frozenset(from_rules | from_overrides)

    def decide(
        self, column: str, tables: Iterable[str] = (), safe: bool = False
    ) -> ColumnRule:
        """Table override, then global rule, then safe aggregate, then default.

        When several tables override the same column the strictest one wins,
        so the outcome does not depend on the order of the tables.
        """
        column = column.lower()
        hits = [
            self.overrides[t.lower()][column]
            for t in tables
            if column in self.overrides.get(t.lower(), {})
        ]
        rule = self.rules.get(column)
        if hits:
            action = max(hits, key=strictness)
            if action == "tokenize" and rule is not None:
                return ColumnRule(action, rule.namespace, rule.prefix)
            return ColumnRule(action)
        if rule is not None:
            return rule
        return ColumnRule("passthrough" if safe else self.default_action)


@dataclass(frozen=True)
class Role:
    name: str
    allowed_tables: tuple[str, ...] = ()
    max_rows: int = 1000
    timeout_seconds: int = 10
    max_concurrent: int = 2
    allow_explain: bool = False
    allow_union: bool = False
    max_union_depth: int = 2
    allow_generic_query: bool = False
    allow_audit_log: bool = False

    @property
    def allowed(self) -> frozenset[str]:
        return frozenset(t.lower() for t in self.allowed_tables)


@dataclass(frozen=True)
class RoleBook:
    roles: Mapping[str, Role]
    large_tables: frozenset[str] = frozenset()
    filter_columns: frozenset[str] = DEFAULT_FILTER_COLUMNS

    @classmethod
    def from_document(cls, doc: Mapping) -> RoleBook:
        roles = {
            name: Role(name, **{**cfg, "allowed_tables": tuple(cfg.get("allowed_tables") or ())})
            for name, cfg in (doc.get("roles") or {}).items()
        }
        columns = frozenset(c.lower() for c in doc.get("large_table_filter_columns") or ())
        return cls(
            roles=roles,
            large_tables=frozenset(t.lower() for t in doc.get("large_tables") or ()),
            filter_columns=columns or DEFAULT_FILTER_COLUMNS,
        )


@dataclass(frozen=True)
class DataSource:
    name: str
    type: str = "mysql"
    database: str = ""
    options: Mapping[str, object] = field(default_factory=dict)

    @property
    def dialect(self) -> str:
        return DIALECT_OF_TYPE.get(self.type.lower(), "mysql")


@dataclass(frozen=True)
class Route:
    pattern: str
    datasource: str


@dataclass(frozen=True)
class SourceCatalog:
    """Data sources plus ordered table routes; the first matching route wins."""

    sources: Mapping[str, DataSource] = field(default_factory=dict)
    routes: tuple[Route, ...] = ()

    @classmethod
    def from_document(cls, doc: Mapping) -> SourceCatalog:
        sources: dict[str, DataSource] = {}
        for entry in doc.get("datasources") or []:
            options = {k: v for k, v in entry.items() if k not in ("name", "type", "database")}
            source = DataSource(
                entry["name"], entry.get("type", "mysql"), entry.get("database", ""), options
            )
            sources.setdefault(source.name, source)
        routes = tuple(
            Route(r["pattern"], r["datasource"]) for r in doc.get("table_routing") or []
        )
        return cls(sources, routes)

    @property
    def databases(self) -> frozenset[str]:
        return frozenset(s.database.lower() for s in self.sources.values() if s.database)

    @cached_property
    def stems(self) -> tuple[dict[str, int], dict[str, int]]:
        """Position of the first route for each whole name and for each prefix."""
        whole: dict[str, int] = {}
        prefixes: dict[str, int] = {}
        for position, route in enumerate(self.routes):
            name = route.pattern.lower()
            (prefixes if name.endswith("*") else whole).setdefault(name.removesuffix("*") if name.endswith("*") else name, position)
        return whole, prefixes

    @cached_property
    def prefix_lengths(self) -> tuple[int, ...]:
        return tuple(sorted({len(stem) for stem in self.stems[1]}))

    def source_of(self, table: str) -> str:
        name, (whole, prefixes) = table.lower(), self.stems
        found = [whole.get(name), *(prefixes.get(name[:n]) for n in self.prefix_lengths if n <= len(name))]
        return min(((p, self.routes[p].datasource) for p in found if p is not None), default=(0, "default"))[1]

    def database_of(self, table: str) -> str:
        source = self.sources.get(self.source_of(table))
        return source.database if source else ""

    def dialect_of(self, table: str | None) -> str:
        source = self.sources.get(self.source_of(table) if table else "default")
        return source.dialect if source else "mysql"


_VARIABLE = re.compile(r"\$\{(\w+)\}")


def read_document(spark: SparkSession, path: str) -> dict:
    """Read one JSON or YAML config file from any storage Spark can reach; a folder must hold one file.

    ``${NAME}`` stands for an environment variable, nothing if it is unset.
    """
    found = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(found) > 1:
        raise ValueError(f"{path} holds several files: name one policy document")
    if not found:
        return {}
    text = found[0][0]
    try:
        return json.loads(_VARIABLE.sub(lambda m: json.dumps(os.environ.get(m[1], ""))[1:-1], text))
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as exc:
            raise ValueError(f"{path} is not JSON and PyYAML is not installed") from exc
        return yaml.safe_load(_VARIABLE.sub(lambda m: os.environ.get(m[1], ""), text)) or {}
