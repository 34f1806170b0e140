"""Datasets and columns as a role may see them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.errors import AccessDenied
from veilspark.frames import local_frame
from veilspark.operators.masking import column_masking_info
from veilspark.operators.routing import route_tables
from veilspark.policy import MaskingPolicy, Role, RoleBook, SourceCatalog
from veilspark.sources.policy_files import rule_rows
from veilspark.sources.tables import column_catalog, routed_read


def role_tables(spark: SparkSession, book: RoleBook) -> DataFrame:
    """(role, table_name), one row per allowed table."""
    rows = [(r.name, list(r.allowed_tables)) for r in book.roles.values()]
    roles = local_frame(spark, rows, "role string, allowed_tables array<string>")
    return roles.select("role", F.explode("allowed_tables").alias("table_name"))


def list_datasets(
    spark: SparkSession, book: RoleBook, catalog: SourceCatalog, role: str | None = None
) -> DataFrame:
    """Datasets per role: name, type, database and a usage hint."""
    if role is not None and role not in book.roles:
        raise AccessDenied("ROLE_DENIED", "unknown role")
    listed = route_tables(role_tables(spark, book), catalog)
    if role is not None:
        listed = listed.where(F.col("role") == role)
    kind = F.when(F.lower("table_name").startswith("v_"), "view").otherwise("table")
    return listed.select(
        "role",
        F.col("table_name").alias("name"),
        kind.alias("type"),
        "database",
        F.format_string("SELECT ... FROM %s WHERE ...", "table_name").alias("usage"),
    )


def describe_frames(
    spark: SparkSession, tables: Mapping[str, DataFrame], policy: MaskingPolicy
) -> DataFrame:
    """Every column of the given tables with its masking action."""
    columns = column_catalog(spark, tables)
    return column_masking_info(columns, rule_rows(spark, policy), policy)


def describe_columns(
    spark: SparkSession, table: str, role: Role, catalog: SourceCatalog, policy: MaskingPolicy
) -> DataFrame:
    """Columns of one allowed table: name, type, nullable, comment, masking."""
    if table.lower() not in role.allowed:
        raise AccessDenied("TABLE_NOT_ALLOWED", table)
    frame = routed_read(spark, table, catalog)
    return (
        describe_frames(spark, {table: frame}, policy)
        .orderBy("ordinal")
        .select(
            F.col("column_name").alias("name"),
            F.col("data_type").alias("type"),
            "nullable",
            "comment",
            "masking",
        )
    )
