"""Whole-table masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import masking as om
from veilspark.operators.measures import Measure, safe_agg
from veilspark.operators.tags import lineage_of, tag_source
from veilspark.plans.registry import derive, derive_sql, plan, table, values_sql
from veilspark.plans.settings import (
    PERSON,
    POLICY,
    POLICY_DOCUMENT,
    email_sql,
    keys,
    phone_sql,
    residual_sql,
    residual_test_sql,
    token_sql,
)
from veilspark.policy import MaskingPolicy
from veilspark.sources.policy_files import expand_rules, override_rows, rule_rows

_CUST = token_sql("c_name", "customer", "CUST")
_SUP = token_sql("s_name", "supplier", "SUP")

# A policy-change feed: every event redefines three columns.
RULE_FEED = {
    "rule_ord": "event_id",
    "action": "CASE event_type WHEN 'view' THEN 'passthrough' WHEN 'click' THEN 'tokenize' "
              "WHEN 'signup' THEN 'deny' WHEN 'error' THEN 'mask_phone' ELSE 'mask_email' END",
    "namespace": "CASE WHEN event_type = 'click' THEN 'user' END",
    "prefix": "CASE WHEN event_type = 'click' THEN 'U' END",
}
FEED_COLUMNS = ("'Name_' || user_id", "'PHONE_' || user_id % 7", "'name_' || (user_id + 1)")

_RULES_SQL = f"""SELECT lower(col) AS column_name,
    arg_max(action, rule_ord * 4 + pos) AS action,
    coalesce(arg_max(coalesce(namespace, ''), rule_ord * 4 + pos), '') AS namespace,
    coalesce(arg_max(coalesce(prefix, ''), rule_ord * 4 + pos), '') AS prefix,
    max(rule_ord) AS rule_ord
    FROM ({' UNION ALL '.join(
        derive_sql('events', {**RULE_FEED, 'col': c, 'pos': str(i)})
        for i, c in enumerate(FEED_COLUMNS))})
    GROUP BY lower(col)"""


def rule_feed(spark, sf):
    events = table(spark, sf, "events")
    entries = derive(events, {**RULE_FEED, "columns": f"array({', '.join(FEED_COLUMNS)})"})
    return entries


@plan("load_rules", _RULES_SQL)
def load_rules(spark, sf):
    return expand_rules(rule_feed(spark, sf)).select(
        "column_name", "action", "namespace", "prefix", "rule_ord"
    )


@plan(
    "sensitive_columns",
    f"""SELECT column_name FROM ({_RULES_SQL})
        WHERE action IN ('tokenize', 'deny', 'mask_phone', 'mask_email')
        UNION SELECT 'r_name'""",
)
def sensitive_columns(spark, sf):
    rules = expand_rules(rule_feed(spark, sf))
    return om.sensitive_columns(rules, override_rows(spark, POLICY))


# Columns that requests ask for, in changing case.
_ASKED = {
    "event_id": "event_id",
    "table_name": "CASE user_id % 3 WHEN 0 THEN 'Nation' WHEN 1 THEN 'region' ELSE 'customer' END",
    "column_name": "CASE user_id % 8 WHEN 0 THEN 'Customer_Name' WHEN 1 THEN 'PHONE' "
                   "WHEN 2 THEN 'eMail' WHEN 3 THEN 'n_name' WHEN 4 THEN 'R_NAME' "
                   "WHEN 5 THEN 'amount' WHEN 6 THEN 'props' ELSE 'total_' || event_type END",
}
_RULE_VALUES = values_sql(
    [(c, r.action, r.namespace, r.prefix) for c, r in POLICY.rules.items()],
    ["rule_column", "rule_action", "rule_ns", "rule_pfx"],
    "r",
)


@plan(
    "column_masking_info",
    f"""SELECT event_id, column_name, coalesce(rule_action, 'deny') AS masking
        FROM ({derive_sql('events', _ASKED)}) a LEFT JOIN {_RULE_VALUES}
        ON lower(column_name) = rule_column""",
)
def column_masking_info(spark, sf):
    asked = derive(table(spark, sf, "events"), _ASKED)
    info = om.column_masking_info(asked, rule_rows(spark, POLICY), POLICY)
    return info.select("event_id", "column_name", "masking")


_FORCED = (
    "CASE WHEN lower(table_name) = 'nation' AND lower(column_name) = 'n_name' THEN 'passthrough' "
    "WHEN lower(table_name) = 'region' AND lower(column_name) = 'r_name' THEN 'deny' END"
)


@plan(
    "resolve_actions",
    f"""SELECT event_id, table_name, column_name,
        coalesce({_FORCED}, rule_action,
                 CASE WHEN column_name LIKE 'total%' THEN 'passthrough' END, 'deny') AS action,
        CASE WHEN {_FORCED} IS NULL THEN coalesce(rule_ns, '') ELSE '' END AS namespace,
        CASE WHEN {_FORCED} IS NULL THEN coalesce(rule_pfx, '') ELSE '' END AS prefix
        FROM ({derive_sql('events', _ASKED)}) a LEFT JOIN {_RULE_VALUES}
        ON lower(column_name) = rule_column""",
)
def resolve_actions(spark, sf):
    asked = derive(table(spark, sf, "events"), _ASKED).select(
        "event_id",
        "table_name",
        F.col("column_name").alias("source_column"),
        F.col("column_name").alias("output_name"),
        F.col("column_name").startswith("total").alias("is_safe"),
    )
    decided = om.resolve_action_rows(
        asked, rule_rows(spark, POLICY), override_rows(spark, POLICY), POLICY
    )
    return decided.select(
        "event_id", "table_name", F.col("source_column").alias("column_name"),
        "action", "namespace", "prefix",
    )


@plan(
    "apply_masking_customer",
    f"""SELECT id, {token_sql('customer_name', 'customer', 'CUST')} AS customer_name,
        {phone_sql('phone')} AS phone, {email_sql('email')} AS email,
        CAST(NULL AS VARCHAR) AS id_card, CAST(NULL AS VARCHAR) AS address,
        {residual_sql('status')} AS status, balance, CAST(NULL AS VARCHAR) AS nickname
        FROM ({derive_sql('customer', PERSON)})""",
)
def apply_masking_customer(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    return om.apply_masking(people, POLICY, keys(spark))


_WIDE_SQL = f"""SELECT l_orderkey, l_linenumber, {_CUST} AS c_name, {_SUP} AS s_name,
    n_name, o_orderpriority, l_extendedprice, CAST(NULL AS VARCHAR) AS p_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey"""


@plan("apply_masking_wide", _WIDE_SQL)
def apply_masking_wide(spark, sf):
    """Every order line with names of both sides.

    A token depends on its value alone, so the dimension tables are masked
    before they are joined: one token per customer, not one per line. The
    final call finds those columns done and only treats the rest.
    """
    k = keys(spark)
    t = {
        n: tag_source(table(spark, sf, n), n)
        for n in ("lineitem", "orders", "customer", "supplier", "nation", "part")
    }
    small = {n: om.apply_masking(t[n], POLICY, k) for n in ("customer", "supplier", "nation", "part")}
    wide = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(small["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(small["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(small["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(small["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "l_orderkey", "l_linenumber", "c_name", "s_name", "n_name",
            "o_orderpriority", "l_extendedprice", "p_type",
        )
    )
    return om.apply_masking(wide, POLICY, k)


@plan(
    "unknown_action_null",
    "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_mktsegment, c_acctbal FROM customer",
)
def unknown_action_null(spark, sf):
    odd = MaskingPolicy.from_document(
        {
            "rules": [
                {"columns": ["c_mktsegment"], "action": "scramble"},
                {"columns": ["c_custkey", "c_acctbal"], "action": "passthrough"},
            ]
        }
    )
    frame = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return om.apply_masking(frame, odd, keys(spark))


@plan(
    "table_override",
    f"""SELECT c_custkey, n_name, CAST(NULL AS VARCHAR) AS r_name,
        {token_sql('n_name', 'nation', 'NAT')} AS renamed
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
)
def table_override(spark, sf):
    """An override belongs to its table: other sources of the name keep the rule."""
    nation = tag_source(table(spark, sf, "nation"), "nation")
    other = tag_source(table(spark, sf, "nation"), "country").select(
        F.col("n_nationkey").alias("k"), F.col("n_name").alias("renamed")
    )
    joined = (
        tag_source(table(spark, sf, "customer"), "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(tag_source(table(spark, sf, "region"), "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(other, F.col("n_nationkey") == F.col("k"))
        .select("c_custkey", "n_name", "r_name", "renamed")
    )
    return om.apply_masking(joined, POLICY, keys(spark))


@plan(
    "override_without_rule",
    f"""SELECT p_partkey, {token_sql('p_type', '', '')} AS p_type FROM part""",
)
def override_without_rule(spark, sf):
    doc = {**POLICY_DOCUMENT, "table_overrides": {"part": {"p_type": "tokenize"}}}
    frame = tag_source(table(spark, sf, "part"), "part").select("p_partkey", "p_type")
    return om.apply_masking(frame, MaskingPolicy.from_document(doc), keys(spark))


@plan(
    "default_deny",
    """SELECT event_id, event_type, value, CAST(NULL AS VARCHAR) AS props FROM events""",
)
def default_deny(spark, sf):
    events = tag_source(table(spark, sf, "events"), "events")
    return om.apply_masking(
        events.select("event_id", "event_type", "value", "props"), POLICY, keys(spark)
    )


@plan(
    "alias_lineage_nested",
    f"SELECT c_custkey AS id, {_CUST} AS amount, {_CUST} AS total FROM customer",
)
def alias_lineage_nested(spark, sf):
    """A sensitive column renamed twice, through a subquery and a CTE."""
    tagged = tag_source(table(spark, sf, "customer"), "customer")
    nested = spark.sql(
        """WITH c AS (SELECT c_custkey, c_name AS balance, c_name AS x FROM {t})
           SELECT c_custkey AS id, amount, x AS total
           FROM (SELECT c_custkey, balance AS amount, x FROM c)""",
        t=tagged,
    )
    return om.apply_masking(nested, POLICY, keys(spark))


@plan(
    "alias_lineage_report",
    f"""SELECT count(*) AS n_orders, 'customer.c_name' AS source_of_amount,
        'orders.o_totalprice' AS source_of_x FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def alias_lineage_report(spark, sf):
    """What the lineage says about a joined and renamed frame, with its size."""
    c = tag_source(table(spark, sf, "customer"), "customer")
    o = tag_source(table(spark, sf, "orders"), "orders")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("amount"), F.col("o_totalprice").alias("x")
    )
    found = lineage_of(joined)
    return joined.agg(F.count(F.lit(1)).alias("n_orders")).select(
        "n_orders",
        F.lit(found["amount"]).alias("source_of_amount"),
        F.lit(found["x"]).alias("source_of_x"),
    )


@plan(
    "safe_aggregate",
    f"""SELECT {_CUST} AS c_name, round(sum(o_totalprice), 2) AS spent, count(*) + 1 AS n_plus,
        round(avg(o_totalprice), 6) AS mean, CAST(NULL AS VARCHAR) AS last_status
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name""",
)
def safe_aggregate(spark, sf):
    c = tag_source(table(spark, sf, "customer"), "customer")
    o = tag_source(table(spark, sf, "orders"), "orders")
    per_key = safe_agg(
        o,
        ["o_custkey"],
        {
            "n": Measure.count(),
            "paid": Measure.sum("o_totalprice"),
            "status": Measure.max("o_orderstatus"),
        },
    )
    totals = safe_agg(
        per_key.join(c, F.col("o_custkey") == F.col("c_custkey")),
        ["c_name"],
        {
            "spent": Measure.sum("paid").rounded(2),
            "n_plus": Measure.sum("n").plus(1),
            "mean": Measure.sum("paid").over(Measure.sum("n")).rounded(6),
            "last_status": Measure.max("status"),
        },
    )
    return om.apply_masking(totals, POLICY, keys(spark))


@plan(
    "masked_fields",
    f"""SELECT array_to_string(list_sort(['address', 'customer_name', 'email', 'id_card', 'nickname',
        'phone'] || CASE WHEN bool_or({' OR '.join(residual_test_sql('status', k) for k in
        ('id_card', 'bank_card', 'phone'))}) THEN ['status'] ELSE [] END), ',') AS fields
        FROM ({derive_sql('customer', PERSON)})""",
)
def masked_fields(spark, sf):
    people = derive(table(spark, sf, "customer"), PERSON)
    report = om.masked_fields(people, POLICY)
    return report.select(F.array_join("masked_fields", ",").alias("fields"))


@plan(
    "masked_fields_documents",
    f"""SELECT CASE WHEN bool_or({' OR '.join(residual_test_sql('text', k) for k in
        ('id_card', 'bank_card', 'phone'))}) THEN 'text' ELSE '' END AS fields FROM documents""",
)
def masked_fields_documents(spark, sf):
    report = om.masked_fields(table(spark, sf, "documents"), POLICY)
    return report.select(F.array_join("masked_fields", ",").alias("fields"))


@plan(
    "token_join",
    f"""SELECT c.customer_name, c.balance, o.n_orders FROM
        (SELECT {_CUST} AS customer_name, c_acctbal AS balance FROM customer) c JOIN
        (SELECT {_CUST} AS customer_name, count(*) AS n_orders FROM orders
         JOIN customer ON o_custkey = c_custkey GROUP BY c_name) o USING (customer_name)""",
)
def token_join(spark, sf):
    """Two results masked apart, joined on the token they share."""
    k = keys(spark)
    c = tag_source(table(spark, sf, "customer"), "customer")
    o = tag_source(table(spark, sf, "orders"), "orders")
    left = om.apply_masking(
        c.select(F.col("c_name").alias("customer_name"), F.col("c_acctbal").alias("balance")),
        POLICY, k,
    )
    per_key = safe_agg(o, ["o_custkey"], {"n": Measure.count()})
    counted = safe_agg(
        per_key.join(c, F.col("o_custkey") == F.col("c_custkey")),
        ["c_name"],
        {"n_orders": Measure.sum("n")},
    )
    right = om.apply_masking(counted, POLICY, k)
    return om.token_join(left, right, ("customer_name", "c_name")).select(
        "customer_name", "balance", "n_orders"
    )


@plan(
    "token_join_crowded",
    f"""SELECT customer_name, count(*) AS pairs, sum(l.n) AS weight FROM
        (SELECT {_CUST.replace("c_name", "name")} AS customer_name, n FROM (SELECT CASE WHEN o_orderkey % 3 = 0
         THEN 'hot' ELSE 'cust ' || o_custkey END AS name, o_orderkey % 5 AS n FROM orders WHERE o_orderkey % 40 < 8)) l
        JOIN (SELECT {_CUST.replace("c_name", "name")} AS customer_name FROM (SELECT CASE WHEN event_id % 3 = 0
         THEN 'hot' ELSE 'cust ' || user_id END AS name FROM events WHERE event_id % 40 < 8)) r USING (customer_name)
        GROUP BY customer_name""",
)
def token_join_crowded(spark, sf):
    """A token that a third of the rows hold on both sides: its pairs are dealt out over a grid, equal ones counted."""
    k = keys(spark)
    orders = table(spark, sf, "orders").where("o_orderkey % 40 < 8").selectExpr(
        "IF(o_orderkey % 3 = 0, 'hot', concat('cust ', o_custkey)) AS customer_name", "o_orderkey % 5 AS amount"
    )
    visits = table(spark, sf, "events").where("event_id % 40 < 8").selectExpr(
        "IF(event_id % 3 = 0, 'hot', concat('cust ', user_id)) AS client_name"
    )
    left, right = (om.apply_masking(f, POLICY, k) for f in (orders, visits))
    joined = om.token_join(left, right, ("customer_name", "client_name"), crowded=True, copies="copies")
    return joined.groupBy("customer_name").agg(
        F.sum("copies").alias("pairs"), F.sum(F.col("amount") * F.col("copies")).alias("weight")
    )


@plan(
    "token_join_other_namespace",
    f"""SELECT count(*) AS matches FROM
        (SELECT {_CUST} AS t FROM customer) a JOIN
        (SELECT {token_sql('c_name', 'supplier', 'SUP')} AS t FROM customer) b USING (t)""",
)
def token_join_other_namespace(spark, sf):
    k = keys(spark)
    names = table(spark, sf, "customer")
    a = om.apply_masking(names.select(F.col("c_name").alias("customer_name")), POLICY, k)
    b = om.apply_masking(names.select(F.col("c_name").alias("supplier_name")), POLICY, k)
    joined = om.token_join(a, b, ("customer_name", "supplier_name"))
    return joined.agg(F.count(F.lit(1)).alias("matches"))


@plan(
    "masked_union",
    f"""SELECT {_CUST} AS name, c_acctbal AS balance, c_nationkey AS code FROM customer
        UNION ALL SELECT {_SUP}, s_acctbal, s_nationkey FROM supplier""",
)
def masked_union(spark, sf):
    c = tag_source(table(spark, sf, "customer"), "customer").selectExpr(
        "c_name AS name", "c_acctbal AS balance", "c_nationkey AS code"
    )
    s = tag_source(table(spark, sf, "supplier"), "supplier").selectExpr(
        "s_name", "s_acctbal", "s_nationkey"
    )
    return om.mask_union([c, s], POLICY, keys(spark))


@plan(
    "masked_union_strictest",
    f"""SELECT CAST(NULL AS VARCHAR) AS label, {token_sql('c_mktsegment', 'customer', 'CUST')} AS who
        FROM customer UNION ALL SELECT CAST(NULL AS VARCHAR), {_CUST} FROM customer
        UNION ALL SELECT CAST(NULL AS VARCHAR), {_SUP} FROM supplier""",
)
def masked_union_strictest(spark, sf):
    """A harmless first branch must not unmask the ones below it."""
    c = tag_source(table(spark, sf, "customer"), "customer")
    s = tag_source(table(spark, sf, "supplier"), "supplier")
    r = c.selectExpr("c_mktsegment AS label", "c_mktsegment AS who")
    secret = c.select(F.upper("c_name").alias("label"), "c_name")
    return om.mask_union([r, secret, s.selectExpr("s_name AS label", "s_name")], POLICY, keys(spark))



@plan(
    "masked_union_of_masked",
    f"SELECT c_nationkey, {token_sql('c_name', 'customer', 'CUST')} AS c_name FROM customer",
)
def masked_union_of_masked(spark, sf):
    """Branches masked early stay as they are beside raw ones."""
    rows = table(spark, sf, "customer").select("c_nationkey", "c_name")
    early = om.apply_masking(rows.where("c_nationkey < 10"), POLICY, keys(spark))
    return om.mask_union([early, rows.where("c_nationkey >= 10")], POLICY, keys(spark))


@plan(
    "union_distinct_mixed",
    f"""SELECT {token_sql('n', 'customer', 'CUST')} AS c_name FROM (SELECT DISTINCT c_name AS n FROM customer)
        UNION ALL
        SELECT {token_sql('n', 'supplier', 'SUP')}
        FROM (SELECT DISTINCT s_name AS n FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer))""",
)
def union_distinct_mixed(spark, sf):
    """Rows equal before masking are one row, though branches have namespaces of their own."""
    names = table(spark, sf, "customer").select("c_name")
    others = table(spark, sf, "supplier").select("s_name").union(names.where("c_name < 'Customer#000000100'"))
    return om.mask_union([names, others], POLICY, keys(spark), distinct=True)
