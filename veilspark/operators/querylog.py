"""Policy verdicts over a whole query log.

Inputs are tables:

* ``log``   – query_id, role, client, tool, ts, sql_text, dialect
* ``shape`` – query_id, statement_type, n_statements, union_depth, limit_value, has_where
* ``refs``  – query_id, ord, catalog_name, schema_name, table_name
* ``uses``  – query_id, ord, column_name, context, func

The text yields lexical facts; structure comes from a lineage feed. A query
without a shape row could not be parsed and fails closed. Every check is a
column expression, and every input is shuffled by query id once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilspark.errors import denial_message
from veilspark.functions.sqltext import (
    UNPARSEABLE,
    banned_function,
    has_lock,
    has_user_variable,
    capped_text,
    redact_literals,
    system_schema,
    text_flags,
)
from veilspark.operators.routing import dialect_column, source_column
from veilspark.policy import MaskingPolicy, RoleBook, SourceCatalog

GENERIC_TOOL = "execute_query"
DENIAL = "struct<code: string, detail: string>"

# Order in which uses of a sensitive column are judged.
_CONTEXT_CHECKS = (
    ("function", "FUNCTION_DENIED"),
    ("order_by", "COLUMN_DENIED"),
    ("having", "COLUMN_DENIED"),
    ("case", "COLUMN_DENIED"),
    ("arithmetic", "COLUMN_DENIED"),
)
_RANK_STEP = 1 << 32  # context rank outweighs any position within a query


def denial(code: str, detail: Column | str = "") -> Column:
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(code).alias("code"), F.coalesce(text, F.lit("")).alias("detail"))


def role_value(book: RoleBook, role: Column, attribute: str) -> Column:
    """A role setting as a column; null for an unknown role."""
    out = F.lit(None)
    for name, cfg in book.roles.items():
        out = F.when(role == name, F.lit(getattr(cfg, attribute))).otherwise(out)
    return out


def role_allows(book: RoleBook, role: Column, table: Column) -> Column:
    out = F.lit(False)
    for name, cfg in book.roles.items():
        listed = sorted(cfg.allowed)
        allowed = F.lower(table).isin(listed) if listed else F.lit(False)
        out = F.when(role == name, allowed).otherwise(out)
    return out


def _analyzes(sql: Column) -> Column:
    return F.upper(sql).contains("ANALYZE")


def statement_denial(book: RoleBook, analyzes: Column | None = None) -> Column:
    analyzes = _analyzes(F.col("sql_text")) if analyzes is None else analyzes
    may_explain = F.coalesce(role_value(book, F.col("role"), "allow_explain"), F.lit(False))
    kind = F.col("statement_type")
    explain = (
        F.when(~may_explain, denial("STATEMENT_DENIED", "EXPLAIN is not allowed for this role"))
        .when(analyzes, denial("EXPLAIN_ANALYZE_DENIED"))
    )
    describe = F.when(
        ~may_explain, denial("STATEMENT_DENIED", "DESCRIBE is not allowed for this role")
    )
    return (
        F.when(F.col("n_statements") != 1, denial("MULTI_STATEMENT"))
        .when(kind.isin("select", "union", "subquery"), F.lit(None).cast(DENIAL))
        .when(kind == "explain", explain)
        .when(kind == "describe", describe)
        .otherwise(denial("STATEMENT_DENIED"))
    )


def variable_denial() -> Column:
    return F.when(has_user_variable(F.col("sql_text")), denial("USER_VARIABLE_DENIED"))


def lock_denial() -> Column:
    return F.when(has_lock(F.col("sql_text"), F.col("dialect")), denial("FOR_UPDATE_DENIED"))


def function_denial() -> Column:
    name = banned_function(F.col("sql_text"), F.col("dialect"))
    return F.when(name.isNotNull(), denial("DANGEROUS_FUNCTION", name))


def table_denial(book: RoleBook, catalog: SourceCatalog) -> Column:
    """Judge one table reference: schema, database, then the name itself."""
    dialect, schema, table = F.col("dialect"), F.col("schema_name"), F.col("table_name")
    has_schema = F.coalesce(schema, F.lit("")) != ""
    is_tsql = dialect == "tsql"
    owner = F.when(is_tsql, F.col("catalog_name")).otherwise(schema)
    databases = sorted(catalog.databases)
    if databases:
        foreign = (F.coalesce(owner, F.lit("")) != "") & ~F.lower(owner).isin(databases)
    else:
        foreign = F.lit(False)
    detail = F.concat(F.lit("database "), owner, F.lit(" is not configured"))
    return (
        F.when(has_schema & system_schema(schema, dialect), denial("SYSTEM_TABLE_DENIED", schema))
        .when(foreign, denial("TABLE_NOT_ALLOWED", detail))
        .when(system_schema(table, dialect), denial("SYSTEM_TABLE_DENIED", F.lower(table)))
        .when(~role_allows(book, F.col("role"), table), denial("TABLE_NOT_ALLOWED", table))
    )


def union_denial(book: RoleBook) -> Column:
    role, depth = F.col("role"), F.col("union_depth")
    allowed = F.coalesce(role_value(book, role, "allow_union"), F.lit(False))
    limit = F.coalesce(role_value(book, role, "max_union_depth"), F.lit(2))
    detail = F.concat(
        F.lit("depth "), depth.cast("string"), F.lit(" exceeds "), limit.cast("string")
    )
    return F.when(
        depth > 0,
        F.when(~allowed, denial("UNION_DENIED")).when(depth > limit, denial("UNION_DENIED", detail)),
    )


def column_denial(policy: MaskingPolicy) -> tuple[Column, Column]:
    """(denial, rank) of one column use; both null when the use is fine."""
    column, context = F.col("column_name"), F.col("context")
    listed = sorted(policy.sensitive_columns)
    sensitive = F.lower(column).isin(listed) if listed else F.lit(False)
    verdict, rank = F.lit(None).cast(DENIAL), F.lit(None).cast("long")
    for i, (name, code) in enumerate(_CONTEXT_CHECKS):
        if name == "function":
            detail = F.concat(
                F.lit("function "), F.upper("func"), F.lit(" on sensitive column "), column
            )
        else:
            detail = F.concat(
                F.lit("sensitive column "), column, F.lit(f" in {name.replace('_', ' ').upper()}")
            )
        hit = sensitive & (context == name)
        verdict = F.when(hit, denial(code, detail)).otherwise(verdict)
        rank = F.when(hit, F.lit(i * _RANK_STEP) + F.col("ord")).otherwise(rank)
    return verdict, rank


def filter_denial() -> Column:
    """Needs ``large`` (sorted large tables) and ``time_filter`` on the row."""
    names = F.array_join("large", ", ")
    missing = ~F.col("has_where") | ~F.coalesce("time_filter", F.lit(False))
    return F.when((F.size("large") > 0) & missing, denial("FILTER_REQUIRED", names))


def effective_limit(book: RoleBook) -> Column:
    """Capped row limit of a SELECT; other statements have none."""
    cap = F.coalesce(role_value(book, F.col("role"), "max_rows"), F.lit(1000))
    asked = F.when(F.col("limit_value") >= 0, F.col("limit_value"))
    return F.when(
        F.col("statement_type") == "select", F.least(F.coalesce(asked, cap), cap).cast("long")
    )


def text_facts(log: DataFrame, redact: bool = False) -> DataFrame:
    """What the text alone decides, as four small columns.

    Computed where the log is scanned: a plan that does not return the text
    then never has to shuffle it. With ``redact`` the text without literals
    takes the place of the text.
    """
    sql, dialect = F.col("sql_text"), F.col("dialect")
    facts = log.select(
        *log.columns,
        _analyzes(sql).alias("_analyzes"),
        has_user_variable(sql).alias("_variable"),
        text_flags(sql, dialect).alias("_flags"),
    ).withColumns({"_locks": F.col("_flags.locks"), "_banned": F.col("_flags.banned")})
    if redact:
        facts = facts.withColumn("redacted", redact_literals(sql, dialect)).drop("sql_text")
    return facts.drop("_flags")


def _failures(df: DataFrame, verdict: Column) -> DataFrame:
    return (
        df.select("query_id", verdict.alias("d"))
        .where(F.col("d").isNotNull())
        .select("query_id", "d.code", "d.detail")
    )


def fail_closed(log: DataFrame, shape: DataFrame) -> DataFrame:
    """Queries no fact row exists for, with the text their audit row carries."""
    text = F.when(F.col("tool") == GENERIC_TOOL, F.lit(UNPARSEABLE)).otherwise(F.lit(""))
    return log.join(shape.select("query_id"), "query_id", "left_anti").select(
        "query_id", F.lit("SYNTAX_ERROR").alias("code"), text.alias("audit_text")
    )


def check_statements(log: DataFrame, shape: DataFrame, book: RoleBook) -> DataFrame:
    return _failures(log.join(shape, "query_id"), statement_denial(book))


def check_user_variables(log: DataFrame) -> DataFrame:
    return _failures(log, variable_denial())


def check_locks(log: DataFrame) -> DataFrame:
    return _failures(log, lock_denial())


def check_functions(log: DataFrame) -> DataFrame:
    return _failures(log, function_denial())


def table_facts(
    log: DataFrame, refs: DataFrame, book: RoleBook, catalog: SourceCatalog
) -> DataFrame:
    """Per query: first table denial, sorted table names, large tables used.

    References are reduced to distinct tables before they meet the log, so a
    query that mentions tables very often does not swamp one task.
    """
    distinct = refs.groupBy("query_id", "catalog_name", "schema_name", "table_name").agg(
        F.min("ord").alias("ord")
    )
    judged = distinct.join(log.select("query_id", "role", "dialect"), "query_id").withColumn(
        "d", table_denial(book, catalog)
    )
    name = F.lower("table_name")
    large = sorted(book.large_tables)
    # One flag per large table: their number is that of a config list, and
    # flags, unlike a set, leave the aggregate on the order the join left.
    used = [F.max(name == t).alias(f"_large_{i}") for i, t in enumerate(large)]
    grouped = judged.groupBy("query_id").agg(
        F.min_by("d", F.when(F.col("d").isNotNull(), F.col("ord"))).alias("table_denial"),
        F.array_sort(F.collect_set(name)).alias("tables"),
        *used,
    )
    names = [F.when(F.col(f"_large_{i}"), F.lit(t)) for i, t in enumerate(large)]
    listed = F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")
    return grouped.select("query_id", "table_denial", "tables", listed.alias("large"))


def column_facts(uses: DataFrame, policy: MaskingPolicy, book: RoleBook) -> DataFrame:
    """Per query: first column denial and whether a time column is filtered.

    Harmless uses are dropped before the shuffle.
    """
    verdict, rank = column_denial(policy)
    listed = sorted(book.filter_columns)
    timed = (F.col("context") == "where") & F.lower("column_name").isin(listed)
    kept = uses.select(
        "query_id", verdict.alias("d"), rank.alias("rank"), timed.alias("timed")
    ).where(F.col("d").isNotNull() | F.col("timed"))
    return kept.groupBy("query_id").agg(
        F.min_by("d", "rank").alias("column_denial"),
        F.max("timed").alias("time_filter"),
    )


def check_tables(
    log: DataFrame, refs: DataFrame, book: RoleBook, catalog: SourceCatalog
) -> DataFrame:
    return _failures(table_facts(log, refs, book, catalog), F.col("table_denial"))


def check_union(log: DataFrame, shape: DataFrame, book: RoleBook) -> DataFrame:
    return _failures(log.join(shape, "query_id"), union_denial(book))


def check_column_uses(uses: DataFrame, policy: MaskingPolicy, book: RoleBook) -> DataFrame:
    return _failures(column_facts(uses, policy, book), F.col("column_denial"))


def check_large_filters(
    shape: DataFrame, refs: DataFrame, uses: DataFrame, book: RoleBook
) -> DataFrame:
    """Only references to large tables and time filters are shuffled."""
    name = F.lower("table_name")
    large = (
        refs.where(name.isin(sorted(book.large_tables)))
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_set(name)).alias("large"))
    )
    timed = (
        uses.where(
            (F.col("context") == "where")
            & F.lower("column_name").isin(sorted(book.filter_columns))
        )
        .select("query_id", F.lit(True).alias("time_filter"))
        .distinct()
    )
    joined = shape.join(large, "query_id").join(timed, "query_id", "left")
    return _failures(joined, filter_denial())


def limits(log: DataFrame, shape: DataFrame, book: RoleBook) -> DataFrame:
    return (
        log.join(shape, "query_id")
        .select("query_id", effective_limit(book).alias("effective_limit"))
        .where(F.col("effective_limit").isNotNull())
    )


def tables_of(refs: DataFrame) -> DataFrame:
    """Sorted distinct lower-cased table names per query."""
    named = refs.where(F.coalesce(F.col("table_name"), F.lit("")) != "")
    names = F.array_sort(F.collect_set(F.lower("table_name")))
    return named.groupBy("query_id").agg(names.alias("tables"))


def resolve_dialect(log: DataFrame, refs: DataFrame, catalog: SourceCatalog) -> DataFrame:
    """Dialect of the data source of each query's first table."""
    first = refs.groupBy("query_id").agg(F.min_by("table_name", "ord").alias("first_table"))
    routed = log.select("query_id").join(first, "query_id", "left")
    source = F.when(
        F.col("first_table").isNotNull(), source_column(F.col("first_table"), catalog)
    ).otherwise("default")
    return routed.select("query_id", dialect_column(source, catalog).alias("dialect"))


def judge(
    log: DataFrame,
    shape: DataFrame,
    refs: DataFrame,
    uses: DataFrame,
    book: RoleBook,
    policy: MaskingPolicy,
    catalog: SourceCatalog,
    redact: bool = False,
) -> DataFrame:
    """The log with ``code, detail, tables, effective_limit``; code null = allowed.

    The first failing check decides, in the order syntax, statement, user
    variable, lock, banned function, table, union, column use, large table.
    ``unlimited`` says that a SELECT states no row limit. With ``redact`` the text
    leaves the scan as ``redacted``, without its literals, and never as it is.
    """
    facts = text_facts(log, redact)
    kept = [c for c in facts.columns if not c.startswith("_")]
    joined = (
        facts
        .join(shape, "query_id", "left")
        .join(table_facts(log, refs, book, catalog), "query_id", "left")
        .join(column_facts(uses, policy, book), "query_id", "left")
    )
    first = F.coalesce(
        F.when(F.col("statement_type").isNull(), denial("SYNTAX_ERROR")),
        statement_denial(book, F.col("_analyzes")),
        F.when(F.col("_variable"), denial("USER_VARIABLE_DENIED")),
        F.when(F.col("_locks"), denial("FOR_UPDATE_DENIED")),
        F.when(F.col("_banned").isNotNull(), denial("DANGEROUS_FUNCTION", F.col("_banned"))),
        F.col("table_denial"),
        union_denial(book),
        F.col("column_denial"),
        filter_denial(),
    )
    no_tables = F.array().cast("array<string>")
    unlimited = (F.col("statement_type") == "select") & F.col("limit_value").isNull()
    return joined.select(
        *kept,
        first.alias("verdict"),
        F.coalesce("tables", no_tables).alias("tables"),
        effective_limit(book).alias("effective_limit"),
        F.col("statement_type").isNotNull().alias("parsed"),
        F.coalesce(unlimited, F.lit(False)).alias("unlimited"),
    ).select(
        *kept, "verdict.code", "verdict.detail", "tables", "effective_limit", "parsed", "unlimited"
    )


def query_verdict(*args, **kwargs) -> DataFrame:
    """query_id, code, detail and the full message for every logged query."""
    judged = judge(*args, **kwargs)
    return judged.select(
        "query_id",
        "code",
        "detail",
        denial_message(F.col("code"), F.col("detail")).alias("message"),
    )


def audit_text(parsed: Column, tool: Column, redacted: Column, dialect: Column, capped: Column) -> Column:
    """Literal-free text, with the limit put into a ``capped`` one; an unparsed query leaves a mark or nothing by path."""
    missing = F.when(tool == GENERIC_TOOL, F.lit(UNPARSEABLE)).otherwise(F.lit(""))
    return F.when(parsed, F.when(capped, capped_text(redacted, dialect)).otherwise(redacted)).otherwise(missing)
