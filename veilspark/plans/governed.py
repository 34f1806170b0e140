"""Governed queries: checked, lineage-tagged, capped and masked."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from veilspark.errors import AccessDenied
from veilspark.frames import local_frame
from veilspark.operators import governed as g
from veilspark.operators.edges import LineageStore, closed_edges
from veilspark.operators.catalog import describe_frames, list_datasets
from veilspark.operators.joins import bounded_broadcast
from veilspark.operators.measures import Measure
from veilspark.operators.masking import apply_masking
from veilspark.operators.querylog import denial, table_denial
from veilspark.operators.routing import route_tables
from veilspark.policy import Route
from veilspark.plans.registry import derive, derive_sql, in_list, plan, quote, table, values_sql
from veilspark.sources.audit_log import shared_folder
from veilspark.plans.settings import (
    BOOK,
    DEVELOPER,
    POLICY,
    ROUTES,
    VIEWER,
    file_catalog,
    keys,
    token_sql,
)

_CUST = token_sql("c_name", "customer", "CUST")
_SUP = token_sql("s_name", "supplier", "SUP")


def session(spark, sf, role="developer"):
    return g.GovernedSession.open(spark, role, BOOK, POLICY, file_catalog(sf), keys(spark))


def source(spark, sf, name, role=DEVELOPER):
    return g.governed_table(spark, name, role, file_catalog(sf))


def masked(spark, df, trust_names=False):
    return apply_masking(df, POLICY, keys(spark), trust_names=trust_names)


def spending(spark, sf):
    """Customers with the number and sum of their orders.

    Orders are reduced to one row per customer before the join, so a customer
    with very many orders reaches it as a single row.
    """
    per_key = g.governed_group(
        source(spark, sf, "orders"),
        ["o_custkey"],
        {"n": Measure.count(), "spent": Measure.sum("o_totalprice")},
        POLICY,
    )
    return per_key.join(source(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def outcome(build) -> str:
    """The code a governed plan is refused with, or ``ok``."""
    try:
        build()
    except AccessDenied as exc:
        return exc.code
    return "ok"


@plan(
    "flagship",
    f"""SELECT {_CUST} AS c_name, round(sum(o_totalprice), 2) AS total_spent, count(*) AS n_orders
        FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_name ORDER BY total_spent DESC, n_orders DESC, c_name LIMIT 1000""",
)
def flagship(spark, sf):
    """Spending per customer: grouped on raw names, capped top list, masked last."""
    totals = g.governed_group(
        spending(spark, sf),
        ["c_name"],
        {"total_spent": Measure.sum("spent").rounded(2), "n_orders": Measure.sum("n")},
        POLICY,
    )
    ranked = g.governed_sort(totals, ["-total_spent", "-n_orders"], POLICY)
    return masked(spark, g.capped_limit(ranked, 1000, DEVELOPER.max_rows))


# Who tries to open which table: one attempt per event.
ATTEMPTS = {
    "event_id": "event_id",
    "role": "CASE user_id % 5 WHEN 0 THEN 'viewer' WHEN 4 THEN 'guest' ELSE 'developer' END",
    "dialect": "CASE WHEN event_type IN ('error', 'view') THEN 'tsql' ELSE 'mysql' END",
    "catalog_name": "CASE event_type WHEN 'error' THEN 'Sales' WHEN 'view' THEN 'other' ELSE '' END",
    "schema_name": "CASE event_type WHEN 'signup' THEN 'Information_Schema' WHEN 'error' THEN 'dbo' "
                   "WHEN 'view' THEN 'dbo' WHEN 'click' THEN 'SALES' ELSE '' END",
    "table_name": "CASE user_id % 7 WHEN 0 THEN 'Customer' WHEN 1 THEN 'nation' WHEN 2 THEN 'payroll' "
                  "WHEN 3 THEN 'sys' WHEN 4 THEN 'master' WHEN 5 THEN 'orders' ELSE 'region' END",
}


def allowed_sql(role: str, name: str) -> str:
    return (
        f"CASE {role} "
        + " ".join(f"WHEN '{r.name}' THEN lower({name}) IN {in_list(r.allowed)}" for r in BOOK.roles.values())
        + " ELSE FALSE END"
    )


_MYSQL_SYS = "('mysql', 'sys', 'performance_schema', 'information_schema')"
_TSQL_SYS = "('master', 'tempdb', 'model', 'msdb', 'information_schema')"


def system_sql(name: str, dialect: str = "dialect") -> str:
    return (
        f"CASE WHEN {dialect} = 'tsql' THEN lower({name}) IN {_TSQL_SYS} "
        f"ELSE lower({name}) IN {_MYSQL_SYS} END"
    )


def owner_sql(dialect: str = "dialect") -> str:
    return f"CASE WHEN {dialect} = 'tsql' THEN catalog_name ELSE schema_name END"


def table_code_sql(allowed: str) -> str:
    known = in_list(ROUTES.databases)
    return (
        f"CASE WHEN coalesce(schema_name, '') <> '' AND ({system_sql('schema_name')}) THEN 'SYSTEM_TABLE_DENIED' "
        f"WHEN coalesce({owner_sql()}, '') <> '' AND lower({owner_sql()}) NOT IN {known} THEN 'TABLE_NOT_ALLOWED' "
        f"WHEN {system_sql('table_name')} THEN 'SYSTEM_TABLE_DENIED' "
        f"WHEN NOT ({allowed}) THEN 'TABLE_NOT_ALLOWED' END"
    )


def table_detail_sql(allowed: str) -> str:
    known = in_list(ROUTES.databases)
    return (
        f"CASE WHEN coalesce(schema_name, '') <> '' AND ({system_sql('schema_name')}) THEN schema_name "
        f"WHEN coalesce({owner_sql()}, '') <> '' AND lower({owner_sql()}) NOT IN {known} "
        f"THEN 'database ' || {owner_sql()} || ' is not configured' "
        f"WHEN {system_sql('table_name')} THEN lower(table_name) "
        f"WHEN NOT ({allowed}) THEN table_name END"
    )


_ALLOWED = allowed_sql("role", "table_name")


@plan(
    "governed_table",
    f"""SELECT event_id, coalesce({table_code_sql(_ALLOWED)}, 'ok') AS code,
        coalesce({table_detail_sql(_ALLOWED)}, '') AS detail
        FROM ({derive_sql('events', ATTEMPTS)})""",
)
def governed_table(spark, sf):
    attempts = derive(table(spark, sf, "events"), ATTEMPTS)
    verdict = F.coalesce(table_denial(BOOK, ROUTES), denial("ok"))
    return attempts.select("event_id", verdict.alias("v")).select("event_id", "v.code", "v.detail")


@plan(
    "governed_select",
    f"SELECT c_custkey AS id, {_CUST} AS who, c_mktsegment FROM customer",
)
def governed_select(spark, sf):
    customer = source(spark, sf, "customer")
    return masked(
        spark,
        g.governed_select(
            customer, {"id": "c_custkey", "who": "c_name", "c_mktsegment": "c_mktsegment"}
        ),
    )


@plan(
    "governed_filter_equals",
    f"""SELECT o_orderkey, {_CUST} AS c_name, o_totalprice FROM orders JOIN customer
        ON o_custkey = c_custkey
        WHERE c_name = 'Customer#000000042' AND o_totalprice > 1000""",
)
def governed_filter_equals(spark, sf):
    """The raw comparison reaches the scan of customer as a pushed filter."""
    joined = source(spark, sf, "orders").join(
        source(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    rows = g.governed_filter(
        joined, POLICY, [("c_name", "=", "Customer#000000042")], F.col("o_totalprice") > 1000
    )
    return masked(spark, g.governed_select(rows, ["o_orderkey", "c_name", "o_totalprice"]))


@plan(
    "governed_filter_ranges",
    f"""SELECT c_custkey, {_CUST} AS c_name FROM customer
        WHERE c_name LIKE 'Customer#0000000%' AND c_nationkey IN (1, 2, 3)
        AND c_acctbal BETWEEN 0 AND 5000""",
)
def governed_filter_ranges(spark, sf):
    rows = g.governed_filter(
        source(spark, sf, "customer"),
        POLICY,
        [
            ("c_name", "like", "Customer#0000000%"),
            ("c_nationkey", "in", [1, 2, 3]),
            ("c_acctbal", "between", (0, 5000)),
        ],
    )
    return masked(spark, g.governed_select(rows, ["c_custkey", "c_name"]))


@plan(
    "governed_group",
    f"""SELECT {_CUST} AS c_name, c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS spent,
        round(avg(o_totalprice), 6) AS mean
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, c_mktsegment""",
)
def governed_group(spark, sf):
    grouped = g.governed_group(
        spending(spark, sf),
        ["c_name", "c_mktsegment"],
        {
            "n": Measure.sum("n"),
            "spent": Measure.sum("spent").rounded(2),
            "mean": Measure.sum("spent").over(Measure.sum("n")).rounded(6),
        },
        POLICY,
    )
    return masked(spark, grouped)


# The same name written with and without surplus blanks.
_SPACED = "CASE WHEN o_orderkey % 3 = 0 THEN '  ' || c_name || ' ' ELSE c_name END"


@plan(
    "governed_regroup",
    f"""SELECT {_CUST} AS c_name, count(*) AS n, round(sum(o_totalprice), 2) AS spent,
        round(avg(o_totalprice), 6) AS mean
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name""",
)
def governed_regroup(spark, sf):
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    spaced = joined.select(F.expr(_SPACED).alias("c_name"), "o_totalprice")
    return g.governed_regroup(
        spaced,
        ["c_name"],
        {
            "n": Measure.count(),
            "spent": Measure.sum("o_totalprice").rounded(2),
            "mean": Measure.avg("o_totalprice").rounded(6),
        },
        POLICY,
        keys(spark),
    )


@plan(
    "governed_group_raw_keys",
    f"""SELECT {_CUST} AS c_name, o_orderkey % 3 = 0 AS spaced, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name, o_orderkey % 3 = 0""",
)
def governed_group_raw_keys(spark, sf):
    """Without regrouping, names that differ in blanks stay two rows with one token."""
    joined = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    spaced = joined.select(F.expr(_SPACED).alias("c_name"), (F.col("o_orderkey") % 3 == 0).alias("type"))
    grouped = g.governed_group(spaced, ["c_name", "type"], {"n": Measure.count()}, POLICY)
    return masked(spark, grouped, trust_names=True).withColumnRenamed("type", "spaced")


@plan(
    "governed_having",
    f"""SELECT {_CUST} AS c_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey
        GROUP BY c_name HAVING count(*) >= 12""",
)
def governed_having(spark, sf):
    grouped = g.governed_group(spending(spark, sf), ["c_name"], {"n": Measure.sum("n")}, POLICY)
    return masked(spark, g.governed_having(grouped, F.col("n") >= 12, POLICY))


@plan(
    "governed_sort_topk",
    f"""SELECT o_orderkey, o_totalprice, {_CUST} AS c_name FROM orders JOIN customer
        ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""",
)
def governed_sort_topk(spark, sf):
    joined = source(spark, sf, "orders").join(
        source(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    rows = g.governed_select(joined, ["o_orderkey", "o_totalprice", "c_name"])
    ranked = g.governed_sort(rows, ["-o_totalprice", "o_orderkey"], POLICY)
    return masked(spark, g.capped_limit(ranked, 25, DEVELOPER.max_rows))


@plan(
    "governed_derive",
    """SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS amount,
       CAST(NULL AS DOUBLE) AS unlisted FROM lineitem""",
)
def governed_derive(spark, sf):
    """A registered name passes, an unlisted one falls to the default."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = source(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    with_net = g.governed_derive(lines, "amount", net, POLICY, "arithmetic")
    with_both = g.governed_derive(with_net, "unlisted", net + 1, POLICY, "arithmetic")
    return masked(
        spark, with_both.select("l_orderkey", "l_linenumber", "amount", "unlisted")
    )


_USES = [
    ("select c_name", "ok"),
    ("upper of c_name", "FUNCTION_DENIED"),
    ("case on c_name", "COLUMN_DENIED"),
    ("count of c_name", "FUNCTION_DENIED"),
    ("having on c_name", "COLUMN_DENIED"),
    ("sort by c_name", "COLUMN_DENIED"),
    ("sort by alias of c_name", "COLUMN_DENIED"),
    ("range in strict mode", "COLUMN_DENIED"),
    ("filter orders by status", "FILTER_REQUIRED"),
    ("three branches", "ok"),
    ("four branches", "UNION_DENIED"),
    ("two branches as viewer", "UNION_DENIED"),
    ("viewer opens customer", "TABLE_NOT_ALLOWED"),
]
_TRIED = {"attempt_no": f"user_id % {len(_USES)}", "user_id": "user_id"}


@plan(
    "denied_uses",
    f"""SELECT attempt, code, count(*) AS n, count(DISTINCT user_id) AS users
        FROM ({derive_sql('events', _TRIED)}) t
        JOIN {values_sql([(i, *u) for i, u in enumerate(_USES)], ['i', 'attempt', 'code'], 'a')}
        ON attempt_no = i GROUP BY ALL""",
)
def denied_uses(spark, sf):
    """A log of attempted uses, each answered by the governed operators."""
    c = source(spark, sf, "customer")
    orders = source(spark, sf, "orders")
    viewer = session(spark, sf, "viewer")
    tries = [
        lambda: g.governed_select(c, ["c_name"]),
        lambda: g.governed_derive(c, "x", F.upper("c_name"), POLICY),
        lambda: g.governed_derive(c, "x", F.when(F.col("c_name") == "a", 1), POLICY, "case"),
        lambda: g.governed_group(c, ["c_nationkey"], {"n": Measure.count("c_name")}, POLICY),
        lambda: g.governed_having(
            g.governed_group(c, ["c_name"], {"n": Measure.count()}, POLICY),
            F.col("c_name") > "a", POLICY,
        ),
        lambda: g.governed_sort(c, ["c_name"], POLICY),
        lambda: g.governed_sort(g.governed_select(c, {"amount": "c_name"}), ["amount"], POLICY),
        lambda: g.governed_filter(c, POLICY, [("c_name", ">", "a")], strict=True),
        lambda: g.require_filter(orders, "orders", [("o_orderstatus", "=", "F")], BOOK),
        lambda: g.check_union(3, DEVELOPER),
        lambda: g.check_union(4, DEVELOPER),
        lambda: g.check_union(2, VIEWER),
        lambda: viewer.table("customer"),
    ]
    answers = [(i, name, outcome(use)) for i, ((name, _), use) in enumerate(zip(_USES, tries))]
    attempts = derive(table(spark, sf, "events"), _TRIED)
    answered = attempts.join(
        F.broadcast(local_frame(spark, answers, "attempt_no long, attempt string, code string")),
        "attempt_no",
    )
    return answered.groupBy("attempt", "code").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")
    )


@plan(
    "capped_limit",
    """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5000""",
)
def capped_limit(spark, sf):
    ranked = source(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    ranked = g.governed_sort(ranked, ["-o_totalprice", "o_orderkey"], POLICY)
    return masked(spark, g.capped_limit(ranked, 99_999, DEVELOPER.max_rows))


@plan(
    "fetch_capped",
    """SELECT o_orderkey, (SELECT count(*) FROM orders) > 1000 AS truncated FROM orders
       ORDER BY o_orderkey LIMIT 1000""",
)
def fetch_capped(spark, sf):
    ranked = source(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey")
    rows, truncated = g.fetch_capped(ranked, VIEWER.max_rows)
    return masked(spark, rows).withColumn("truncated", F.lit(truncated))


@plan(
    "governed_union_all",
    f"""SELECT c_custkey AS id, 'c' AS type, {_CUST} AS name, c_acctbal AS balance FROM customer
        UNION ALL SELECT s_suppkey, 's', {_SUP}, s_acctbal FROM supplier
        ORDER BY balance DESC, id, type LIMIT 5000""",
)
def governed_union_all(spark, sf):
    parts = []
    for name, p, key in (("customer", "c", "custkey"), ("supplier", "s", "suppkey")):
        marked = g.governed_derive(source(spark, sf, name), "type", F.lit(p), POLICY)
        columns = {"id": f"{p}_{key}", "type": "type", "name": f"{p}_name", "balance": f"{p}_acctbal"}
        parts.append(g.governed_select(marked, columns))
    return g.governed_union(
        parts, DEVELOPER, POLICY, keys(spark), order=["-balance", "id", "type"]
    )


@plan(
    "governed_union_distinct",
    """SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier
       UNION SELECT n_nationkey FROM nation""",
)
def governed_union_distinct(spark, sf):
    parts = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")]
    frames = [g.governed_select(source(spark, sf, t), {"id": c}) for t, c in parts]
    return g.governed_union(frames, DEVELOPER, POLICY, keys(spark), distinct=True)


@plan(
    "required_filter",
    """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus = 'F'""",
)
def required_filter(spark, sf):
    """The mandatory time filter is pushed to the scan with the rest."""
    rows = session(spark, sf).table(
        "orders",
        [("o_orderdate", ">=", F.lit("1997-01-01").cast("timestamp_ntz")), ("o_orderstatus", "=", "F")],
    )
    return masked(spark, g.governed_select(rows, ["o_orderkey", "o_orderdate", "o_totalprice"]))


@plan(
    "governed_subquery",
    f"""SELECT {_CUST} AS amount, n_orders FROM (
        SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_totalprice > 100000
        GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey""",
)
def governed_subquery(spark, sf):
    big = g.governed_filter(source(spark, sf, "orders"), POLICY, [("o_totalprice", ">", 100000)])
    inner = g.governed_group(big, ["o_custkey"], {"n_orders": Measure.count()}, POLICY)
    c = g.governed_select(source(spark, sf, "customer"), {"k": "c_custkey", "amount": "c_name"})
    joined = inner.join(c, F.col("o_custkey") == F.col("k"))
    return masked(spark, g.governed_select(joined, ["amount", "n_orders"]))


def _summary_frame(spark, sf):
    o, c = source(spark, sf, "orders"), source(spark, sf, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    dated = g.governed_derive(joined, "year", F.year("o_orderdate"), POLICY)
    return g.governed_derive(dated, "month", F.month("o_orderdate"), POLICY)


def _summary(spark, sf, year, period):
    report = g.summary_report(
        _summary_frame(spark, sf), POLICY, year, period,
        org="c_mktsegment", year_column="year", period_column="month", amount="o_totalprice",
    )
    capped = masked(spark, g.capped_limit(report, None, DEVELOPER.max_rows))
    return capped.select("c_mktsegment", "month", F.round("total_amount", 2).alias("total_amount"))


def _summary_sql(extra: str) -> str:
    return f"""SELECT c_mktsegment, CAST(month(o_orderdate) AS INTEGER) AS month,
        round(sum(o_totalprice), 2) AS total_amount
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE year(o_orderdate) = 1997 {extra} GROUP BY ALL"""


@plan("summary_report", _summary_sql(""))
def summary_report(spark, sf):
    return _summary(spark, sf, 1997, 0)


@plan("summary_report_period", _summary_sql("AND month(o_orderdate) = 6"))
def summary_report_period(spark, sf):
    return _summary(spark, sf, 1997, 6)


@plan(
    "plugin_query",
    f"""SELECT {_CUST} AS c_name, round(sum(o_totalprice), 2) AS total_amount
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE o_totalprice > 250000 AND o_orderdate >= TIMESTAMP '1996-01-01'
        GROUP BY c_name ORDER BY total_amount DESC, c_name LIMIT 5000""",
)
def plugin_query(spark, sf):
    """Fixed SQL with bound values over checked tables."""
    return session(spark, sf).plugin_query(
        """SELECT c_name, round(sum(o_totalprice), 2) AS total_amount
           FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice > :floor
           GROUP BY c_name ORDER BY total_amount DESC""",
        {"floor": 250000},
        ["orders", "customer"],
        tool="big_spenders",
        require_role="developer",
        where={"orders": [("o_orderdate", ">=", F.lit("1996-01-01").cast("timestamp_ntz"))]},
    )


_WHO = {
    "event_id": "event_id",
    "role": "CASE user_id % 3 WHEN 0 THEN 'viewer' ELSE 'developer' END",
}
_DATASETS = values_sql(
    [
        (r.name, t, "view" if t.startswith("v_") else "table", ROUTES.database_of(t),
         f"SELECT ... FROM {t} WHERE ...")
        for r in BOOK.roles.values()
        for t in r.allowed_tables
    ],
    ["d_role", "name", "type", "database", "usage"],
    "d",
)


@plan(
    "list_datasets",
    f"""SELECT role, name, type, database, usage, count(*) AS n_requests
        FROM ({derive_sql('events', _WHO)}) w JOIN {_DATASETS} ON role = d_role GROUP BY ALL""",
)
def list_datasets_plan(spark, sf):
    """What every logged listing request was shown, counted per dataset."""
    asked = derive(table(spark, sf, "events"), _WHO).groupBy("role").agg(
        F.count(F.lit(1)).alias("n_requests")
    )
    shown = list_datasets(spark, BOOK, ROUTES)
    return asked.join(bounded_broadcast(shown), "role").select(
        "role", "name", "type", "database", "usage", "n_requests"
    )


_DESCRIBED = {
    "event_id": "event_id",
    "role": "CASE user_id % 3 WHEN 0 THEN 'viewer' ELSE 'developer' END",
    "asked": "CASE user_id % 4 WHEN 0 THEN 'nation' WHEN 1 THEN 'customer' WHEN 2 THEN 'Region' "
             "ELSE 'supplier' END",
}
_SCHEMAS = {
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
        ("c_acctbal", "double"), ("c_mktsegment", "string"),
    ],
    "supplier": [
        ("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double"),
    ],
}
_COLUMNS = values_sql(
    [
        (t, i, c, kind, POLICY.rules[c].action if c in POLICY.rules else "deny")
        for t, columns in _SCHEMAS.items()
        for i, (c, kind) in enumerate(columns, 1)
    ],
    ["d_table", "ordinal", "name", "type", "masking"],
    "d",
)
_DESCRIBE_SQL = f"""SELECT role, asked, coalesce(ordinal, 0) AS ordinal, coalesce(name, '') AS name,
    coalesce(type, '') AS type, coalesce(masking, '') AS masking,
    CASE WHEN ok THEN 'success' ELSE 'TABLE_NOT_ALLOWED' END AS status, count(*) AS n_requests
    FROM (SELECT *, {allowed_sql('role', 'asked')} AS ok FROM ({derive_sql('events', _DESCRIBED)})) w
    LEFT JOIN {_COLUMNS} ON ok AND lower(asked) = d_table GROUP BY ALL"""


@plan("describe_columns", _DESCRIBE_SQL)
def describe_columns(spark, sf):
    """Every logged describe request with the columns it was shown or its refusal."""
    from veilspark.operators.querylog import role_allows

    frames = {t: table(spark, sf, t) for t in _SCHEMAS}
    described = describe_frames(spark, frames, POLICY).select(
        F.col("table_name").alias("d_table"), "ordinal", F.col("column_name").alias("name"),
        F.col("data_type").alias("type"), "masking",
    )
    asked = derive(table(spark, sf, "events"), _DESCRIBED)
    counted = (
        asked.withColumn("ok", role_allows(BOOK, F.col("role"), F.col("asked")))
        .groupBy("role", "asked", "ok")
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .withColumn("d_table", F.when(F.col("ok"), F.lower("asked")))
    )
    joined = counted.join(bounded_broadcast(described), "d_table", "left")
    return joined.select(
        "role", "asked",
        F.coalesce("ordinal", F.lit(0)).alias("ordinal"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("masking", F.lit("")).alias("masking"),
        F.when(F.col("ok"), "success").otherwise("TABLE_NOT_ALLOWED").alias("status"),
        "n_requests",
    )


_NAMES = {
    "event_id": "event_id",
    "table_name": "CASE user_id % 8 WHEN 0 THEN 'ODS_' || event_type WHEN 1 THEN 'dwd_orders' "
                  "WHEN 2 THEN 'dwd_' || user_id WHEN 3 THEN 'ext_feed' WHEN 4 THEN 'Ledger_' || event_id "
                  "WHEN 5 THEN 'view' WHEN 6 THEN 'view_2' ELSE event_type END",
}


def source_sql(name: str) -> str:
    tests = []
    for r in ROUTES.routes:
        p = r.pattern.lower()
        hit = f"starts_with(lower({name}), {quote(p[:-1])})" if p.endswith("*") else f"lower({name}) = {quote(p)}"
        tests.append(f"WHEN {hit} THEN {quote(r.datasource)}")
    return f"CASE {' '.join(tests)} ELSE 'default' END"


def database_sql(source_expr: str) -> str:
    return (
        f"CASE {source_expr} "
        + " ".join(f"WHEN {quote(s.name)} THEN {quote(s.database)}" for s in ROUTES.sources.values())
        + " ELSE '' END"
    )


_ROUTED_SQL = f"""SELECT event_id, table_name, datasource, {database_sql('datasource')} AS database
    FROM (SELECT *, {source_sql('table_name')} AS datasource FROM ({derive_sql('events', _NAMES)}))"""


@plan("route_tables", _ROUTED_SQL)
def route_tables_plan(spark, sf):
    return route_tables(derive(table(spark, sf, "events"), _NAMES), ROUTES)


@plan("route_tables_by_prefix", _ROUTED_SQL)
def route_tables_by_prefix(spark, sf):
    """The same among eighty routes that match no table: a list of any length is one projection."""
    more = tuple(Route(f"unused{i:02d}_*", "unused") for i in range(80))
    catalog = replace(ROUTES, routes=more + ROUTES.routes)
    return route_tables(derive(table(spark, sf, "events"), _NAMES), catalog)


@plan(
    "plan_union_laundering",
    f"""SELECT label FROM (SELECT {token_sql("c_mktsegment", "customer", "CUST")} AS label FROM customer
        UNION ALL SELECT {token_sql("c_name", "customer", "CUST")} FROM customer) ORDER BY label LIMIT 5000""",
)
def plan_union_laundering(spark, sf):
    """A name brought in by the second branch of a union is masked like a name.

    All rows of the union are masked, before the first ones of them by their tokens are taken.
    """
    own = session(spark, sf)
    customers = own.table("customer")
    names = customers.select(F.col("c_mktsegment").alias("label")).union(customers.select("c_name"))
    masked_rows = apply_masking(names, POLICY, keys(spark))
    return g.capped_limit(masked_rows.orderBy("label"), 5000, DEVELOPER.max_rows)


@plan(
    "plan_union_derived",
    """SELECT code, count(*) AS n FROM (SELECT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS code FROM customer
       UNION ALL SELECT c_mktsegment || '+' || CAST(c_nationkey AS VARCHAR) FROM customer) GROUP BY code""",
)
def plan_union_derived(spark, sf):
    """What was computed from plain columns in every branch may be shown, grouped and counted above the union."""
    own = session(spark, sf)
    rows = [
        g.governed_select(
            g.governed_derive(own.table("customer"), "code", F.concat_ws(mark, "c_mktsegment", F.col("c_nationkey").cast("string")), POLICY),
            ["code"],
        )
        for mark in "-+"
    ]
    return own.finish(g.governed_group(rows[0].union(rows[1]), ["code"], {"n": Measure.count()}, POLICY))


@plan(
    "plan_union_counts",
    """SELECT * FROM (SELECT 'all' AS status, count(*) AS total, round(sum(c_acctbal), 2) AS spent FROM customer
       UNION ALL SELECT 'late', count(*), round(sum(s_acctbal), 2) FROM supplier)""",
)
def plan_union_counts(spark, sf):
    """Counts and sums stay safe through a union; a text constant falls to the default."""
    own = session(spark, sf)
    text = """SELECT status, n AS total, spent FROM (
        SELECT 'all' AS status, count(*) AS n, round(sum(c_acctbal), 2) AS spent FROM {customer}
        UNION ALL SELECT 'late', count(*), round(sum(s_acctbal), 2) FROM {supplier})"""
    counted = own.plugin_query(text, None, ["customer", "supplier"], tool="totals")
    named = F.when(F.col("total") == own.table("customer").count(), "all").otherwise("late")
    return counted.withColumn("status", F.coalesce("status", named))


@plan(
    "plan_star_derive",
    """SELECT c_custkey, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS code, 'FUNCTION_DENIED' AS star
       FROM customer ORDER BY c_custkey LIMIT 5000""",
)
def plan_star_derive(spark, sf):
    """A star is all columns, sensitive ones too, and refused; plain columns may be computed with."""
    own = session(spark, sf)
    customers = own.table("customer")
    try:
        g.governed_derive(customers, "status", F.to_json(F.struct("*")), POLICY)
        star = "allowed"
    except AccessDenied as exc:
        star = exc.code
    code = F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))
    derived = g.governed_select(g.governed_derive(customers, "code", code, POLICY), ["c_custkey", "code"])
    return own.finish(g.governed_sort(derived, ["c_custkey"], POLICY)).withColumn("star", F.lit(star))


@plan(
    "plan_safe_outputs",
    """SELECT c_mktsegment, count(*) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS spent, CAST(NULL AS DOUBLE) AS best
       FROM customer GROUP BY c_mktsegment""",
)
def plan_safe_outputs(spark, sf):
    """COUNT and a wrapped SUM are found safe in the plan; MAX, under whatever name, is not."""
    text = """SELECT c_mktsegment, count(*) AS n, round(coalesce(sum(c_acctbal), 0), 2) AS spent, max(c_acctbal) AS best
              FROM {customer} GROUP BY c_mktsegment"""
    return session(spark, sf).plugin_query(text, None, ["customer"], tool="segments")


_EDGES = [
    ("people", "label", "customer.c_name"), ("people", "nation_id", "customer.c_nationkey"), ("people", "balance", "customer.c_acctbal"),
    ("spending", "label", "customer.c_name"), ("spending", "balance", "customer.c_acctbal"),
    ("labels", "label", "customer.c_name"), ("labels", "label", "supplier.s_name"),
]
_READS = {"event_id": "event_id", "read": "CASE user_id % 4 WHEN 0 THEN 'people' WHEN 1 THEN 'spending' WHEN 2 THEN 'labels' ELSE 'other' END"}


@plan(
    "lineage_edges",
    f"""SELECT view, output, source, count(*) AS n_reads FROM {values_sql(_EDGES, ["view", "output", "source"], "e")}
        JOIN ({derive_sql("events", _READS)}) ON read = view GROUP BY ALL""",
)
def lineage_edges_plan(spark, sf):
    """Base columns behind views of views, unions among them, and how often a log reads each by way of a view."""
    store = LineageStore(spark, shared_folder(spark, "lineage"))
    own = session(spark, sf)
    people = own.table("customer").select(
        F.col("c_name").alias("label"), F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance")
    )
    people = store.save(people, "people")
    store.save(g.governed_group(people, ["label"], {"balance": Measure.sum("balance")}, POLICY), "spending")
    store.save(store.table("spending").select("label").union(own.table("supplier").select("s_name")), "labels")
    reads = derive(table(spark, sf, "events"), _READS).groupBy("read").agg(F.count(F.lit(1)).alias("n_reads"))
    edges = closed_edges(store.edges())
    return edges.join(reads, F.col("read") == F.col("view")).select("view", "output", "source", "n_reads")
