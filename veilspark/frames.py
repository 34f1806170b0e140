"""Small driver-side rows as frames."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Config-sized rows as a local relation.

    Built from Arrow, the rows sit in the plan with a known size and need no
    Python worker, unlike a frame made from a list of tuples.
    """
    layout = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(layout)
    columns = list(zip(*rows)) if rows else [[] for _ in layout.fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), schema=layout)
