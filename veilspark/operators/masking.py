"""Masking of whole tables: one decision per column, one projection per frame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, functions as F, types as T

from veilspark.functions import masking as fm
from veilspark.functions.keys import TokenKeys
from veilspark.operators.joins import crowded_join
from veilspark.operators.lineage import has_union, trace, vouch
from veilspark.operators.tags import (
    CHECKED,
    MASKED,
    SAFE,
    SRC,
    col,
    is_tagged,
    reject_duplicates,
    source_of,
)
from veilspark.policy import SENSITIVE_ACTIONS, ColumnRule, MaskingPolicy, strictness


@dataclass(frozen=True)
class ColumnAction:
    """What happens to one output column."""

    name: str
    data_type: T.DataType
    rule: ColumnRule
    done: bool = False  # masked by an earlier call, left as it is

    @property
    def action(self) -> str:
        return self.rule.action

    @property
    def reported(self) -> bool:
        return self.action != "passthrough"

    @property
    def scanned(self) -> bool:
        """Passed-through text, nested or not, is still searched for personal numbers."""
        return not self.reported and fm.holds_text(self.data_type)


def resolve_actions(
    schema: T.StructType,
    policy: MaskingPolicy,
    tables: Iterable[str] = (),
    lineage: Mapping[str, str] | None = None,
    safe: Iterable[str] = (),
    trust_names: bool | None = None,
) -> list[ColumnAction]:
    """Decide every column once, from the schema alone.

    The source column decides, not the output name. It comes from ``lineage``
    if given, else from the column's tag. In a tagged frame a column without a
    tag was computed, so its name proves nothing and the default applies;
    ``trust_names`` overrides that choice.
    """
    by_name = not is_tagged(schema) if trust_names is None else trust_names
    explicit = {k.lower(): v.lower() for k, v in (lineage or {}).items()}
    safe_names = {s.lower() for s in safe}
    named_tables = [t.lower() for t in tables]
    actions = []
    for f in schema.fields:
        lowered = f.name.lower()
        is_safe = bool(f.metadata.get(SAFE)) or lowered in safe_names
        if MASKED in f.metadata:
            rule = ColumnRule(f.metadata[MASKED])
            actions.append(ColumnAction(f.name, f.dataType, rule, done=True))
            continue
        if lowered in explicit:
            column, scope = explicit[lowered], named_tables
        elif SRC in f.metadata:
            table, column = source_of(f)
            scope = [table]
        elif by_name or is_safe or f.metadata.get(CHECKED):
            column, scope = lowered, named_tables
        else:
            actions.append(ColumnAction(f.name, f.dataType, ColumnRule(policy.default_action)))
            continue
        actions.append(ColumnAction(f.name, f.dataType, policy.decide(column, scope, is_safe)))
    return actions


def masked_column(
    action: ColumnAction,
    policy: MaskingPolicy,
    keys: TokenKeys | None,
    strict: bool = False,
    engine: str = "jvm",
) -> Column:
    """The expression for one column.

    Only text is tokenised or partly masked; other types pass unchanged unless
    ``strict`` asks for them to be turned into text first.
    """
    c = col(action.name)
    if action.done:
        return c
    kind = action.action
    is_text = isinstance(action.data_type, T.StringType)
    if kind == "passthrough":
        return fm.residual_scan_nested(c, action.data_type)
    if kind in ("tokenize", "mask_phone", "mask_email"):
        if not is_text and not strict:
            return c
        text = c if is_text else c.cast("string")
        if kind == "tokenize":
            return fm.tokenize(
                text, action.rule.namespace, action.rule.prefix, keys, policy.placeholders, engine
            )
        return fm.mask_phone(text) if kind == "mask_phone" else fm.mask_email(text)
    return fm.deny(action.data_type)


def project_actions(
    df: DataFrame,
    actions: Sequence[ColumnAction],
    policy: MaskingPolicy,
    keys: TokenKeys | None = None,
    strict: bool = False,
    observation: Observation | None = None,
    engine: str = "jvm",
) -> DataFrame:
    """The projection that carries the actions out.

    A column that says it was masked, though nothing of this library masked it, is denied.
    """
    reject_duplicates(df)
    if keys is None and any(a.action == "tokenize" and not a.done for a in actions):
        keys = TokenKeys.from_env(df.sparkSession)
    if any(a.done for a in actions):
        actions = [
            replace(a, rule=ColumnRule("deny"), done=False) if a.done and None in o.masked else a
            for a, o in zip(actions, trace(df)[0])
        ]
    if observation is not None:
        df = df.observe(observation, *_field_metrics(actions))
    masked = df.select(
        *[
            masked_column(a, policy, keys, strict, engine).alias(a.name, metadata={MASKED: a.action})
            for a in actions
        ]
    )
    return vouch(masked)


def apply_masking(
    df: DataFrame,
    policy: MaskingPolicy,
    keys: TokenKeys | None = None,
    *,
    tables: Iterable[str] = (),
    lineage: Mapping[str, str] | None = None,
    safe: Iterable[str] = (),
    trust_names: bool | None = None,
    strict: bool = False,
    observation: Observation | None = None,
    engine: str = "jvm",
) -> DataFrame:
    """Mask a whole frame, batch or streaming, in a single projection.

    Without ``keys`` the secret is read from the environment, and a missing
    secret raises. With ``observation`` the data-dependent part of the
    masked-field report is gathered in the same pass; see
    :func:`observed_fields`. ``engine`` chooses how token input is normalised;
    see :func:`veilspark.functions.masking.nfkc`.
    """
    actions = frame_actions(df, policy, tables, lineage, safe, trust_names)
    return project_actions(df, actions, policy, keys, strict, observation, engine)


def frame_actions(
    df: DataFrame,
    policy: MaskingPolicy,
    tables: Iterable[str] = (),
    lineage: Mapping[str, str] | None = None,
    safe: Iterable[str] = (),
    trust_names: bool | None = None,
) -> list[ColumnAction]:
    """The actions of :func:`resolve_actions`, those of a union by all of its branches."""
    actions = resolve_actions(df.schema, policy, tables, lineage, safe, trust_names)
    return _over_branches(df, actions, policy, {k.lower() for k in lineage or {}}) if has_union(df) else actions


def _over_branches(
    df: DataFrame, actions: Sequence[ColumnAction], policy: MaskingPolicy, stated: set[str]
) -> list[ColumnAction]:
    """Actions of a frame whose plan has a union: the strictest branch decides each output.

    Metadata above a union is that of the first branch only. A column that is masked
    in some branches and raw in others can't be masked as one.
    """
    out = []
    for action, origin in zip(actions, trace(df)[0]):
        if None in origin.masked and len(origin.masked) > 1:
            raise ValueError(f"{action.name!r} is masked in some branches only: mask_union keeps them apart")
        tagged = [s.partition(".") for s in sorted(origin.sources) if s]
        if None not in origin.masked:
            rule = ColumnRule(max(origin.masked, key=strictness))
            action = ColumnAction(action.name, action.data_type, rule, done=True)
        elif action.name.lower() not in stated and origin.plain and tagged:
            rules = [action.rule, *(policy.decide(column, [table]) for table, _, column in tagged)]
            rules += [ColumnRule(policy.default_action)] * ("" in origin.sources)
            action = ColumnAction(action.name, action.data_type, max(rules, key=lambda r: strictness(r.action)))
        out.append(action)
    return out


def _field_metrics(actions: Sequence[ColumnAction]) -> list[Column]:
    metrics = [F.count(F.lit(1)).alias("rows")]
    for i, a in enumerate(actions):
        if a.scanned and not a.done:
            hit = F.max(F.when(fm.residual_hit_nested(col(a.name), a.data_type), 1).otherwise(0))
            metrics.append(hit.alias(f"hit_{i}"))
    return metrics


def masked_fields(
    df: DataFrame,
    policy: MaskingPolicy,
    *,
    tables: Iterable[str] = (),
    lineage: Mapping[str, str] | None = None,
    safe: Iterable[str] = (),
    trust_names: bool | None = None,
) -> DataFrame:
    """One row, one sorted array: names of the columns masking changes.

    Columns with an acting rule always count; passed-through text columns
    count when at least one cell holds a personal number. An empty frame
    reports nothing. One aggregate pass that reads only the scanned columns.
    """
    actions = frame_actions(df, policy, tables, lineage, safe, trust_names)
    stats = df.agg(*_field_metrics(actions))
    names = [
        F.when(F.lit(a.reported) if not a.scanned or a.done else F.col(f"hit_{i}") == 1, a.name)
        for i, a in enumerate(actions)
    ]
    listed = F.array_sort(F.array_compact(F.array(*names)))
    empty = F.array().cast("array<string>")
    return stats.select(F.when(F.col("rows") > 0, listed).otherwise(empty).alias("masked_fields"))


def observed_fields(actions: Sequence[ColumnAction], observation: Observation) -> list[str]:
    """The masked-field report of a finished query that carried an observation."""
    seen = observation.get
    if not seen.get("rows"):
        return []
    return sorted(
        a.name
        for i, a in enumerate(actions)
        if a.reported or seen.get(f"hit_{i}")
    )


def mask_union(
    frames: Sequence[DataFrame],
    policy: MaskingPolicy,
    keys: TokenKeys | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Union by position where the strictest branch decides every position.

    A union keeps the names and tags of its first branch only, so each branch
    is resolved on its own. Token namespaces stay those of the branch.
    Duplicates are removed on raw values, as a database would, and among
    branches whose columns are treated alike.
    """
    width = {len(f.columns) for f in frames}
    if len(width) != 1:
        raise ValueError("union branches must have the same number of columns")
    names = frames[0].columns
    resolved = [resolve_actions(f.schema, policy) for f in frames]
    groups: dict[tuple[tuple[ColumnRule, bool], ...], list[DataFrame]] = {}
    for frame, own in zip(frames, resolved):
        rules = []
        for position, mine in enumerate(own):
            strictest = max((r[position] for r in resolved), key=lambda a: strictness(a.action))
            keep = strictness(mine.action) == strictness(strictest.action)
            # What is masked stays so unless another branch is stricter; then it is treated like that one.
            rules.append((mine.rule, mine.done) if keep or mine.done and strictest.action != "deny" else (strictest.rule, False))
        groups.setdefault(tuple(rules), []).append(frame.toDF(*names))
    raw = []
    for members in groups.values():
        rows = members[0]
        for other in members[1:]:
            rows = rows.union(other)
        raw.append(rows)
    if distinct:
        raw = _distinct(raw)
    masked = [
        project_actions(
            rows,
            [ColumnAction(f.name, f.dataType, rule, done) for f, (rule, done) in zip(rows.schema.fields, rules)],
            policy,
            keys,
        )
        for rules, rows in zip(groups, raw)
    ]
    out = masked[0]
    for other in masked[1:]:
        out = out.union(other)
    return out


def _distinct(branches: Sequence[DataFrame]) -> list[DataFrame]:
    """The branches without rows that stand in an earlier one or twice, compared before masking."""
    if len(branches) == 1:
        return [branches[0].distinct()]
    names = branches[0].columns
    mark = "veil_branch"
    while mark in {n.lower() for n in names}:
        mark += "_"
    rows = branches[0].withColumn(mark, F.lit(0))
    for i, other in enumerate(branches[1:], 1):
        rows = rows.union(other.withColumn(mark, F.lit(i)))
    first = rows.groupBy(*[col(n) for n in names]).agg(F.min(mark).alias(mark))
    return [first.where(F.col(mark) == i).select(*[col(n) for n in names]) for i in range(len(branches))]


def token_join(
    left: DataFrame,
    right: DataFrame,
    on: str | tuple[str, str],
    how: str = "inner",
    crowded: bool = False,
    copies: str | None = None,
) -> DataFrame:
    """Join two masked frames on a token column.

    Equal values of one namespace carry equal tokens, so masked data stays
    joinable. A popular value makes a hot token: adaptive execution splits its
    partition, and a side that proves small is broadcast. ``crowded``, for inner joins of
    stored frames, looks for tokens that are hot on both sides first and deals their pairs
    out; see :func:`veilspark.operators.joins.crowded_join`. There ``copies`` names a column
    that counts equal joined rows in place of repeating them.
    """
    if copies and not crowded:
        raise ValueError("copies are counted by crowded joins only")
    left_on, right_on = (on, on) if isinstance(on, str) else on
    renamed = right if left_on == right_on else right.withColumnRenamed(right_on, left_on)
    if crowded:
        if how != "inner":
            raise ValueError("only inner joins are dealt out")
        return crowded_join(left, renamed, left_on, copies=copies)
    return left.join(renamed, left_on, how)


def column_masking_info(
    columns: DataFrame,
    rules: DataFrame,
    policy: MaskingPolicy,
    column: str = "column_name",
    table: str | None = None,
) -> DataFrame:
    """Add the masking action of each named column.

    Table overrides are not consulted unless ``table`` names the column that
    holds the table name.
    """
    lookup = rules.select(F.col("column_name").alias("_rule"), F.col("action").alias("_action"))
    named = columns.withColumn("_rule", F.lower(F.col(column)))
    joined = named.join(lookup, "_rule", "left")
    action = F.coalesce("_action", F.lit(policy.default_action))
    if table is not None:
        for name, entries in policy.overrides.items():
            for key, forced in entries.items():
                hit = (F.lower(F.col(table)) == name) & (F.col("_rule") == key)
                action = F.when(hit, F.lit(forced)).otherwise(action)
    return joined.withColumn("masking", action).drop("_rule", "_action")


def sensitive_columns(rules: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Distinct lower-cased columns with a sensitive action in rules or overrides."""
    listed = sorted(SENSITIVE_ACTIONS)
    found = rules.where(F.col("action").isin(listed)).select(F.lower("column_name").alias("column_name"))
    if overrides is not None:
        extra = overrides.where(F.col("action").isin(listed))
        found = found.unionByName(extra.select(F.lower("column_name").alias("column_name")))
    return found.distinct()


def resolve_action_rows(
    columns: DataFrame, rules: DataFrame, overrides: DataFrame, policy: MaskingPolicy
) -> DataFrame:
    """The decision of :func:`resolve_actions` as joins over a table of columns.

    ``columns`` has ``table_name, source_column, output_name, is_safe``. Adds
    ``action, namespace, prefix``. Rules and overrides are joined on their
    lower-cased names; overrides must already be unique per table and column.
    """
    rule = rules.select(
        F.col("column_name").alias("_col"),
        F.col("action").alias("_rule_action"),
        F.col("namespace").alias("_ns"),
        F.col("prefix").alias("_pfx"),
    )
    forced = overrides.select(
        F.col("table_name").alias("_tab"),
        F.col("column_name").alias("_col"),
        F.col("action").alias("_forced"),
    )
    named = columns.withColumn("_col", F.lower("source_column")).withColumn(
        "_tab", F.lower("table_name")
    )
    joined = named.join(rule, "_col", "left").join(forced, ["_tab", "_col"], "left")
    safe = F.when(F.col("is_safe"), F.lit("passthrough"))
    action = F.coalesce("_forced", "_rule_action", safe, F.lit(policy.default_action))
    named = F.col("_forced").isNull() | (F.col("_forced") == "tokenize")
    return (
        joined.withColumn("action", action)
        .withColumn("namespace", F.when(named, F.coalesce("_ns", F.lit(""))).otherwise(""))
        .withColumn("prefix", F.when(named, F.coalesce("_pfx", F.lit(""))).otherwise(""))
        .drop("_col", "_tab", "_rule_action", "_forced", "_ns", "_pfx")
    )
