"""Reading and writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators.joins import bounded_broadcast
from veilspark.plans.registry import derive, derive_sql, plan, table, values_sql
from veilspark.plans.settings import file_catalog
from veilspark.sources import tables as st
from veilspark.sources.audit_log import shared_folder
from veilspark.sources.policy_files import numbered, read_large_registry, read_tokens


@plan(
    "routed_read",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY o_orderstatus""",
)
def routed_read(spark, sf):
    orders = st.routed_read(spark, "orders", file_catalog(sf))
    return orders.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@plan(
    "param_query",
    """SELECT o_orderkey, o_totalprice FROM orders
       WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 100000 AND 200000""",
)
def param_query(spark, sf):
    return st.param_query(
        spark,
        "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = ?"
        " AND o_totalprice BETWEEN ? AND ?",
        ["F", 100000, 200000],
        orders=table(spark, sf, "orders"),
    )


@plan(
    "decimals_as_double",
    """SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DOUBLE) AS quantity,
       count(*) AS n FROM lineitem GROUP BY l_returnflag""",
)
def decimals_as_double(spark, sf):
    exact = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("decimal(12,2)")).alias("quantity"),
        F.count(F.lit(1)).alias("n"),
    )
    return st.decimals_as_double(exact)


_TOUCHED = {
    "event_id": "event_id",
    "table_name": "CASE user_id % 3 WHEN 0 THEN 'nation' WHEN 1 THEN 'supplier' ELSE 'events' END",
}
_COLUMNS = values_sql(
    [
        ("nation", 1, "n_nationkey", "int"), ("nation", 2, "n_name", "string"),
        ("nation", 3, "n_regionkey", "int"),
        ("supplier", 1, "s_suppkey", "bigint"), ("supplier", 2, "s_name", "string"),
        ("supplier", 3, "s_nationkey", "int"), ("supplier", 4, "s_acctbal", "double"),
        ("events", 1, "event_id", "bigint"), ("events", 2, "ts", "timestamp_ntz"),
        ("events", 3, "user_id", "bigint"), ("events", 4, "event_type", "string"),
        ("events", 5, "value", "double"), ("events", 6, "props", "string"),
    ],
    ["c_table", "ordinal", "column_name", "data_type"],
    "c",
)


@plan(
    "column_catalog",
    f"""SELECT table_name, ordinal, column_name, data_type, TRUE AS nullable, '' AS comment,
        count(*) AS n_accesses
        FROM ({derive_sql('events', _TOUCHED)}) t JOIN {_COLUMNS} ON table_name = c_table GROUP BY ALL""",
)
def column_catalog(spark, sf):
    """Column descriptions of the tables a log touches, with how often."""
    touched = derive(table(spark, sf, "events"), _TOUCHED)
    counted = touched.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_accesses"))
    columns = st.column_catalog(
        spark, {t: table(spark, sf, t) for t in ("nation", "supplier", "events")}
    )
    return counted.join(bounded_broadcast(columns), "table_name")


# Registry documents of at most 5000 entries each.
_REGISTRY = {
    "event_id": "event_id",
    "token_hash": "'sha256:' || event_id",
    "client_name": "'user-' || user_id",
    "role": "CASE WHEN user_id % 2 = 0 THEN 'viewer' ELSE 'developer' END",
    "status": "CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END",
    "expires_at": "'2024-0' || (1 + user_id % 9) || '-15'",
}


@plan(
    "read_tokens",
    f"""SELECT token_hash, client_name, role, status, expires_at FROM ({derive_sql('events', _REGISTRY)})""",
)
def read_tokens_plan(spark, sf):
    """Registry documents are written to shared storage and read back."""
    entries = derive(table(spark, sf, "events"), _REGISTRY)
    fields = F.struct("token_hash", "client_name", "role", "status", "expires_at")
    docs = entries.groupBy(F.floor(F.col("event_id") / 5000).alias("doc")).agg(
        F.collect_list(fields).alias("tokens")
    )
    path = shared_folder(spark, "registry")
    docs.select("doc", F.to_json(F.struct("tokens")).alias("value")).write.partitionBy("doc").text(path)
    return read_tokens(spark, path).select(
        "token_hash", "client_name", "role", "status", "expires_at"
    )


@plan(
    "read_large_registry",
    f"""SELECT place, token_hash, client_name, role, status, expires_at FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS place
        FROM ({derive_sql('events', _REGISTRY)}))""",
)
def read_large_registry_plan(spark, sf):
    """One document of all entries, read by as many tasks as its bytes make; entries keep their order."""
    entries = derive(table(spark, sf, "events"), _REGISTRY)
    fields = F.struct("token_hash", "client_name", "role", "status", "expires_at")
    path = shared_folder(spark, "registry")
    # Written as a stream of lines, by ranges that follow each other: the document's two ends, and its entries between.
    lines = entries.select(F.col("event_id").alias("at"), F.concat(F.to_json(fields), F.lit(",")).alias("value"))
    ends = spark.createDataFrame([(-1, '{"tokens": ['), (1 << 62, "null]}")], "at long, value string")
    lines.unionByName(ends).orderBy("at").select("value").write.text(path)
    found = read_large_registry(spark, path)
    # Places for the comparison; F2 needs the order alone.
    place = F.col("place").cast("int")
    return numbered(found, "place").select(place, "token_hash", "client_name", "role", "status", "expires_at")
