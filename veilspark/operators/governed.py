"""What a role may do with a table, checked while the plan is being built.

Checks run on the driver over names and column metadata only. A check that
fails raises ``AccessDenied``; a plan that is returned needs no more checking
and holds ordinary DataFrame operators.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark.errors import AccessDenied
from veilspark.frames import local_frame
from veilspark.functions.keys import TokenKeys
from veilspark.functions.sqltext import SYSTEM_SCHEMAS
from veilspark.operators.lineage import Origin, columns_used, foreign_leaves, sensitive_outputs, trace, vouch
from veilspark.operators.masking import ColumnAction, apply_masking, mask_union, project_actions, resolve_actions
from veilspark.operators.measures import Measure, safe_agg
from veilspark.operators.tags import (
    CHECKED,
    MASKED,
    SAFE,
    col,
    field_map,
    is_tagged,
    source_of,
    tag_source,
)
from veilspark.policy import ROLE_RANK, ColumnRule, MaskingPolicy, Role, RoleBook, SourceCatalog, strictness
from veilspark.sources.tables import param_query, routed_read

Condition = tuple  # (column, operator, value)

_DERIVE_CODES = {"function": "FUNCTION_DENIED", "arithmetic": "COLUMN_DENIED", "case": "COLUMN_DENIED"}


def check_table(
    name: str, role: Role, catalog: SourceCatalog | None = None, dialect: str | None = None
) -> str:
    """Check one possibly qualified table name and return its bare name.

    MySQL names are ``database.table``; T-SQL names are
    ``database.schema.table``.
    """
    parts = name.split(".")
    table = parts[-1]
    schema = parts[-2] if len(parts) > 1 else ""
    database = parts[-3] if len(parts) > 2 else ""
    kind = dialect or (catalog.dialect_of(table) if catalog else "mysql")
    system = SYSTEM_SCHEMAS.get(kind, SYSTEM_SCHEMAS["mysql"])
    if schema.lower() in system:
        raise AccessDenied("SYSTEM_TABLE_DENIED", schema)
    owner = database if kind == "tsql" else schema
    known = catalog.databases if catalog else frozenset()
    if owner and known and owner.lower() not in known:
        raise AccessDenied("TABLE_NOT_ALLOWED", f"database {owner} is not configured")
    if table.lower() in system:
        raise AccessDenied("SYSTEM_TABLE_DENIED", table.lower())
    if table.lower() not in role.allowed:
        raise AccessDenied("TABLE_NOT_ALLOWED", table)
    return table


def governed_table(
    spark: SparkSession,
    name: str,
    role: Role,
    catalog: SourceCatalog,
    dialect: str | None = None,
) -> DataFrame:
    """Check the name, read through the routes and tag every column."""
    table = check_table(name, role, catalog, dialect)
    return tag_source(routed_read(spark, table, catalog), table)


def governed_select(df: DataFrame, columns: Sequence[str] | Mapping[str, str]) -> DataFrame:
    """Plain projection, optionally renamed (output name → column)."""
    pairs = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    return df.select(*[col(source).alias(name) for name, source in pairs])


def condition(column: str, op: str, value=None) -> Column:
    """One comparison on a raw value; never a function of the column."""
    c, kind = col(column), op.lower()
    simple = {
        "=": lambda: c == value,
        "!=": lambda: c != value,
        "<": lambda: c < value,
        "<=": lambda: c <= value,
        ">": lambda: c > value,
        ">=": lambda: c >= value,
        "like": lambda: c.like(value),
        "in": lambda: c.isin(list(value)),
        "between": lambda: c.between(value[0], value[1]),
        "is null": c.isNull,
        "is not null": c.isNotNull,
    }
    if kind not in simple:
        raise ValueError(f"unknown comparison {op!r}")
    return simple[kind]()


def _all_of(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(conditions):
        out = condition(*c) if i == 0 else out & condition(*c)
    return out


def _require_plain(
    df: DataFrame, expr: Column, policy: MaskingPolicy, code: str, what: str
) -> None:
    """Deny when ``expr`` needs a sensitive column of ``df``, by name, star or function."""
    if columns_used(df, expr) & sensitive_outputs(df, policy.sensitive_columns):
        raise AccessDenied(code, what)


def governed_filter(
    df: DataFrame,
    policy: MaskingPolicy,
    where: Sequence[Condition] = (),
    predicate: Column | None = None,
    strict: bool = False,
) -> DataFrame:
    """Filter on raw values, before masking, so the scan can use the filter.

    ``where`` may compare any column; ``strict`` allows only equality on
    sensitive ones. A free ``predicate`` may not touch sensitive columns.
    """
    if strict:
        hidden = sensitive_outputs(df, policy.sensitive_columns)
        for column, op, *_ in where:
            if column.lower() in hidden and op != "=":
                raise AccessDenied("COLUMN_DENIED", f"only = is allowed on {column}")
    out = df
    if predicate is not None:
        _require_plain(df, predicate, policy, "FUNCTION_DENIED", "predicate on a sensitive column")
        out = out.where(predicate)
    return out.where(_all_of(where)) if where else out


def governed_group(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Measure],
    policy: MaskingPolicy,
) -> DataFrame:
    """Group on raw key values; no aggregate may read a sensitive column."""
    hidden = sensitive_outputs(df, policy.sensitive_columns)
    for m in measures.values():
        for column in sorted(c for c in m.columns if c.lower() in hidden):
            raise AccessDenied(
                "FUNCTION_DENIED", f"function {m.func.upper()} on sensitive column {column}"
            )
    return safe_agg(df, keys, measures)


def governed_regroup(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Measure],
    policy: MaskingPolicy,
    token_keys: TokenKeys | None = None,
) -> DataFrame:
    """Like :func:`governed_group`, then merge groups whose masked keys agree.

    Raw values that differ only in spacing share a token. Partial sums and
    counts are built per raw key first, so only one row per raw group is
    tokenised and merged. Returns a masked frame.
    """
    parts: dict[str, Measure] = {}
    for name, m in measures.items():
        if m.func not in ("count", "sum", "avg") or m.distinct or m.divisor:
            raise ValueError("regrouping merges count, sum and avg only")
        if m.func in ("sum", "avg"):
            parts[f"{name}__sum"] = Measure.sum(m.column)
        if m.func in ("count", "avg"):
            parts[f"{name}__n"] = Measure.count(m.column)
    raw = governed_group(df, keys, parts, policy)
    named = not is_tagged(df.schema)
    masked = apply_masking(raw, policy, token_keys, trust_names=named)
    merged = masked.groupBy(*[col(k) for k in keys])
    sums = merged.agg(*[F.sum(col(p)).alias(p) for p in parts])
    values = {
        "sum": lambda n: col(f"{n}__sum"),
        "count": lambda n: col(f"{n}__n"),
        "avg": lambda n: col(f"{n}__sum") / col(f"{n}__n"),
    }
    return vouch(
        sums.select(
            *[col(k) for k in keys],
            *[
                m.wrap(values[m.func](name)).alias(name, metadata={SAFE: True, MASKED: "passthrough"})
                for name, m in measures.items()
            ],
        )
    )


def governed_having(df: DataFrame, predicate: Column, policy: MaskingPolicy) -> DataFrame:
    """Filter groups by aggregate outputs; a raw sensitive key is refused."""
    _require_plain(df, predicate, policy, "COLUMN_DENIED", "sensitive column in HAVING")
    return df.where(predicate)


def governed_sort(df: DataFrame, order: Sequence[str], policy: MaskingPolicy) -> DataFrame:
    """Sort by column names, a leading ``-`` for descending.

    Sorting by a sensitive column would leak its order and is refused.
    """
    fields = field_map(df)
    exprs = []
    for item in order:
        name = item.lstrip("-")
        field = fields[name.lower()]
        if MASKED not in field.metadata and source_of(field)[1] in policy.sensitive_columns:
            raise AccessDenied("COLUMN_DENIED", f"sensitive column {name} in ORDER BY")
        exprs.append(col(name).desc() if item.startswith("-") else col(name).asc())
    return df.orderBy(*exprs)


def governed_derive(
    df: DataFrame, name: str, expr: Column, policy: MaskingPolicy, kind: str = "function"
) -> DataFrame:
    """Add a computed column whose inputs all pass through unmasked themselves.

    The result is judged by its own name: registered names pass, any other
    name is unknown and falls to the default action.
    """
    used = columns_used(df, expr)
    if used & sensitive_outputs(df, policy.sensitive_columns):
        raise AccessDenied(_DERIVE_CODES[kind], f"{kind} on a sensitive column for {name}")
    for action in resolve_actions(df.schema, policy):
        if action.name.lower() in used and action.reported:
            raise AccessDenied(_DERIVE_CODES[kind], f"{kind} on the unregistered column {action.name} for {name}")
    kept = [col(c) for c in df.columns if c.lower() != name.lower()]
    return vouch(df.select(*kept, expr.alias(name, metadata={CHECKED: True})))


def effective_cap(requested: object, max_rows: int) -> int:
    """The requested limit when it is a literal within bounds, else the maximum."""
    if isinstance(requested, bool) or not isinstance(requested, int) or requested < 0:
        return max_rows
    return min(requested, max_rows)


def capped_limit(df: DataFrame, requested: object, max_rows: int) -> DataFrame:
    """Row cap; after a sort Spark turns it into a per-partition top-k."""
    return df.limit(effective_cap(requested, max_rows))


def fetch_capped(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """At most ``max_rows`` rows and whether there were more, both from one run.

    The rows are fetched once, one beyond the cap, which bounds what the driver holds.
    """
    found = df.limit(max_rows + 1).collect()
    rows = [tuple(r) for r in found[:max_rows]]
    return local_frame(df.sparkSession, rows, df.schema), len(found) > max_rows


def check_union(branches: int, role: Role) -> None:
    if branches < 2:
        return
    if not role.allow_union:
        raise AccessDenied("UNION_DENIED")
    depth = branches - 1
    if depth > role.max_union_depth:
        raise AccessDenied("UNION_DENIED", f"depth {depth} exceeds {role.max_union_depth}")


def governed_union(
    frames: Sequence[DataFrame],
    role: Role,
    policy: MaskingPolicy,
    keys: TokenKeys | None = None,
    distinct: bool = False,
    order: Sequence[str] = (),
    limit: object = None,
) -> DataFrame:
    """Union of governed frames, masked branch by branch, sorted and capped.

    Only columns that pass through unmasked may be sorted by.
    """
    check_union(len(frames), role)
    masked = mask_union(frames, policy, keys, distinct)
    if order:
        fields = field_map(masked)
        for item in order:
            if fields[item.lstrip("-").lower()].metadata[MASKED] != "passthrough":
                raise AccessDenied("COLUMN_DENIED", f"sensitive column {item.lstrip('-')} in ORDER BY")
        masked = governed_sort(masked, order, policy)
    return capped_limit(masked, limit, role.max_rows)


def require_filter(
    df: DataFrame, table: str, where: Sequence[Condition], book: RoleBook
) -> DataFrame:
    """Apply ``where``; a large table needs a listed column among them."""
    name = table.split(".")[-1].lower()
    if name in book.large_tables:
        fields = field_map(df)
        used = {source_of(fields[c.lower()])[1] for c, *_ in where}
        if not used & book.filter_columns:
            raise AccessDenied("FILTER_REQUIRED", name)
    return df.where(_all_of(where)) if where else df


def summary_report(
    df: DataFrame,
    policy: MaskingPolicy,
    year: int,
    period: int | None = None,
    org: str = "org_name",
    year_column: str = "n_year",
    period_column: str = "n_period",
    amount: str = "amount",
) -> DataFrame:
    """Total per organisation and period of a year; period 0 means not given."""
    where: list[Condition] = [(year_column, "=", year)]
    if period:
        where.append((period_column, "=", period))
    rows = governed_filter(df, policy, where)
    totals = governed_group(rows, [org, period_column], {"total_amount": Measure.sum(amount)}, policy)
    return governed_sort(totals, [org, period_column], policy)


@dataclass(frozen=True)
class GovernedSession:
    """One client's view: role, policy and sources bound together.

    ``table`` → governed operators → ``finish`` is the whole path of a query.
    """

    spark: SparkSession
    role: Role
    book: RoleBook
    policy: MaskingPolicy
    catalog: SourceCatalog
    keys: TokenKeys | None = None
    client: str = "unknown"
    handed: list | None = None  # tables given out for the query being built
    asked: list | None = None  # names of the tables it asked for, refused ones too

    @classmethod
    def open(cls, spark, role_name: str, book: RoleBook, policy, catalog, keys=None, client="unknown"):
        role = book.roles.get(role_name)
        if role is None:
            raise AccessDenied("ROLE_DENIED", "unknown role")
        return cls(spark, role, book, policy, catalog, keys, client)

    def table(self, name: str, where: Sequence[Condition] = ()) -> DataFrame:
        if self.asked is not None:
            self.asked.append(name.split(".")[-1].lower())
        df = governed_table(self.spark, name, self.role, self.catalog)
        if self.handed is not None:
            self.handed.append(df)
        return require_filter(df, name, where, self.book)

    def query(
        self, build: Callable[[GovernedSession], DataFrame], limit: object = None
    ) -> DataFrame:
        """Ad hoc query built from this session; needs a role that may run them."""
        if not self.role.allow_generic_query:
            raise AccessDenied("ROLE_DENIED", "generic queries are not allowed")
        inner = replace(self, handed=[])
        return inner.finish(build(inner), limit)

    def plugin_query(
        self,
        sql: str,
        args: list | Mapping | None,
        tables: Sequence[str],
        tool: str = "plugin",
        require_role: str | None = None,
        where: Mapping[str, Sequence[Condition]] | None = None,
    ) -> DataFrame:
        """Fixed SQL over checked tables, named ``{table}`` in the text.

        Large tables need their time filter in ``where``, applied before the
        SQL sees them. Outputs that are pure aggregates are found in the plan.
        """
        inner = replace(self, handed=[])
        return inner.finish(inner.plugin_plan(sql, args, tables, tool, require_role, where))

    def plugin_plan(self, sql, args, tables, tool="plugin", require_role=None, where=None) -> DataFrame:
        """The unmasked plan of :meth:`plugin_query`, of the tables it hands out."""
        if require_role:
            needed = ROLE_RANK.get(require_role, 0)
            if ROLE_RANK.get(self.role.name, 0) < needed:
                raise AccessDenied("ROLE_DENIED", f"{tool} needs {require_role} or higher")
        frames = {t: self.table(t, (where or {}).get(t, ())) for t in tables}
        return param_query(self.spark, sql, args, **frames)

    def finish(self, df: DataFrame, limit: object = None) -> DataFrame:
        """Check the plan, cap, then mask: only rows that are returned get tokenised.

        The plan may hold no table but those handed out, no more unions than the role
        has, no sensitive column in a sort or a computation. Each output is judged by
        all columns behind it, the strictest deciding.
        """
        capped, actions = self.prepare(df, limit)
        return project_actions(capped, actions, self.policy, self.keys)

    def prepare(self, df: DataFrame, limit: object = None) -> tuple[DataFrame, list[ColumnAction]]:
        """The checked plan with its cap, and what masking will do to its columns."""
        outputs, found = trace(df)
        if self.handed is not None and (foreign := foreign_leaves(found, self.handed)):
            raise AccessDenied("TABLE_NOT_ALLOWED", f"the plan reads {foreign[0]} beside the tables it asked for")
        check_union(found.unions + 1, self.role)
        if self._sensitive(found.sorted_by):
            raise AccessDenied("COLUMN_DENIED", "sensitive column in ORDER BY")
        if self._sensitive(found.computed_from):
            raise AccessDenied("FUNCTION_DENIED", "function on a sensitive column")
        capped = capped_limit(df, limit, self.role.max_rows)
        return capped, [self._action(f, o) for f, o in zip(capped.schema.fields, outputs)]

    def _sensitive(self, sources: frozenset[str] | set[str]) -> bool:
        return bool({s.partition(".")[2] for s in sources} & self.policy.sensitive_columns)

    def _action(self, column, origin: Origin) -> ColumnAction:
        """What happens to an output. Everything was read through tags: what has none was computed."""
        if None not in origin.masked:
            rule = ColumnRule(max(origin.masked, key=strictness))
            return ColumnAction(column.name, column.dataType, rule, done=True)
        if len(origin.masked) > 1:
            raise AccessDenied("UNION_DENIED", f"{column.name} is masked in some branches only")
        name = column.name.lower()
        if origin.safe:
            rule = self.policy.decide(name, (), True)
        elif origin.plain:
            rules = [self.policy.decide(c, [t]) if t else ColumnRule(self.policy.default_action) for t, _, c in (s.partition(".") for s in sorted(origin.sources))]
            rule = max(rules, key=lambda r: strictness(r.action))
        elif origin.checked:
            rule = self.policy.decide(name)
        else:
            rule = ColumnRule(self.policy.default_action)
        return ColumnAction(column.name, column.dataType, rule)
