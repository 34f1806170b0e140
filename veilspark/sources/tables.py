"""Routed reading of tables and the numeric output edge."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from veilspark.frames import local_frame
from veilspark.operators.tags import col
from veilspark.policy import DataSource, SourceCatalog

FILE_TYPES = frozenset({"parquet", "orc", "json", "csv"})
#: Tasks of a split JDBC read that names no number of its own.
DEFAULT_PARTITIONS = 200
_MYSQL = frozenset({"mysql", "mariadb"})
_SQLSERVER = frozenset({"sqlserver", "mssql"})


def jdbc_options(source: DataSource, table: str) -> dict[str, str]:
    """Spark JDBC options for one table of a MySQL or SQL Server source.

    ``partition_column`` with ``lower_bound`` and ``upper_bound`` splits the
    read; without them JDBC reads through a single connection, which only
    suits small tables. ``partitions`` says into how many tasks it is split; how
    many connections are open at once is up to the cores of the cluster.
    """
    opts = source.options
    host = opts.get("host", "127.0.0.1")
    kind = source.type.lower()
    if kind in _MYSQL:
        port = opts.get("port", 3306)
        out = {
            "url": f"jdbc:mysql://{host}:{port}/{source.database}",
            "driver": "com.mysql.cj.jdbc.Driver",
            "dbtable": f"`{table}`",
        }
    elif kind in _SQLSERVER:
        port = opts.get("port", 1433)
        encrypt = "true" if _truthy(opts.get("encrypt", "yes")) else "false"
        trust = "true" if _truthy(opts.get("trust_server_certificate", "yes")) else "false"
        out = {
            "url": (
                f"jdbc:sqlserver://{host}:{port};databaseName={source.database};"
                f"encrypt={encrypt};trustServerCertificate={trust}"
            ),
            "driver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
            "dbtable": f"[{opts.get('schema', 'dbo')}].[{table}]",
        }
    else:
        raise ValueError(f"unsupported data source type: {source.type}")
    out["user"] = str(opts.get("user", ""))
    out["password"] = str(opts.get("password", ""))
    out["fetchsize"] = str(opts.get("fetchsize", 10_000))
    if "timeout_seconds" in opts:
        out["queryTimeout"] = str(opts["timeout_seconds"])
    if opts.get("partition_column"):
        out["partitionColumn"] = str(opts["partition_column"])
        out["lowerBound"] = str(opts["lower_bound"])
        out["upperBound"] = str(opts["upper_bound"])
        out["numPartitions"] = str(opts.get("partitions", DEFAULT_PARTITIONS))
    return out


def _truthy(value: object) -> bool:
    return str(value).lower() in ("yes", "true", "1")


def read_source(spark: SparkSession, source: DataSource, table: str) -> DataFrame:
    kind = source.type.lower()
    if kind in FILE_TYPES:
        path = str(source.options["path"]).replace("{table}", table)
        options = {k: v for k, v in source.options.items() if k not in ("path", "schema")}
        reader = spark.read.format(kind).options(**options)
        if "schema" in source.options:
            reader = reader.schema(source.options["schema"])
        return reader.load(path)
    return spark.read.format("jdbc").options(**jdbc_options(source, table)).load()


def routed_read(spark: SparkSession, table: str, catalog: SourceCatalog) -> DataFrame:
    """Pick the data source by the first matching route, then read the table."""
    name = catalog.source_of(table)
    source = catalog.sources.get(name)
    if source is None:
        raise ValueError(f"data source {name!r} is not configured")
    return read_source(spark, source, table)


def param_query(
    spark: SparkSession,
    sql: str,
    args: list | Mapping | None = None,
    **frames: DataFrame,
) -> DataFrame:
    """Fixed SQL text with bound values (``?`` or ``:name``).

    Tables are passed as frames and named ``{table}`` in the text. The text itself can
    name files or catalogue tables as well: ``GovernedSession`` checks the plan for them.
    """
    return spark.sql(sql, args=args, **frames)


def decimals_as_double(df: DataFrame) -> DataFrame:
    """Cast every decimal column to double, as results leave the engine."""
    return df.select(
        *[
            col(f.name).cast("double").alias(f.name, metadata=f.metadata)
            if isinstance(f.dataType, T.DecimalType)
            else col(f.name)
            for f in df.schema.fields
        ]
    )


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column in ordinal order, read from schemas and not from data."""
    rows = [
        (
            table, i, f.name, f.dataType.simpleString(), f.nullable,
            f.metadata.get("comment", ""),
        )
        for table, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    schema = (
        "table_name string, ordinal int, column_name string, data_type string,"
        " nullable boolean, comment string"
    )
    return local_frame(spark, rows, schema)
