"""Column lineage as a table: which output comes from which source, through what."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.frames import local_frame
from veilspark.operators.lineage import Origin, trace
from veilspark.operators.tags import col, tag_source

EDGE_SCHEMA = "view string, output string, source string, through string"


def _through(origin: Origin) -> str:
    """The strongest thing that happens to a column on its way: masked, aggregated, computed, or nothing."""
    masked = sorted(a for a in origin.masked if a is not None)
    if masked:
        return f"masked: {', '.join(masked)}"
    if origin.aggregated:
        return "aggregated"
    return "plain" if origin.plain else "computed"


def lineage_edges(df: DataFrame, view: str) -> DataFrame:
    """``view, output, source, through``: a row for each output of ``df`` and each tagged column behind it.

    Read from the analysed plan, through every branch of every union. A source is
    ``table.column`` in lower case; what has no tag behind it, such as a constant, gives no row.
    """
    rows = [
        (view.lower(), name.lower(), source, _through(origin))
        for name, origin in zip(df.columns, trace(df)[0])
        for source in sorted(origin.sources)
        if source
    ]
    return local_frame(df.sparkSession, rows, EDGE_SCHEMA)


def closed_edges(edges: DataFrame) -> DataFrame:
    """``view, output, source, steps``: every base column behind every output, over views of views.

    A source whose table is itself a view leads on to that view's sources; ``steps`` is the
    least number of views on the way. Grows by one level of views in each round.
    """
    direct = edges.select(F.concat_ws(".", "view", "output").alias("name"), "view", "output", "source").distinct()
    reached = direct.select("view", "output", "source", F.lit(1).alias("steps"))
    frontier = reached
    while True:
        inner = direct.select(F.col("name").alias("source"), F.col("source").alias("base"))
        frontier = frontier.join(inner, "source").select("view", "output", F.col("base").alias("source"), (F.col("steps") + 1).alias("steps"))
        frontier = frontier.distinct().join(reached, ["view", "output", "source"], "left_anti")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    views = direct.select(F.col("name").alias("source")).distinct()
    shortest = reached.groupBy("view", "output", "source").agg(F.min("steps").alias("steps"))
    return shortest.join(views, "source", "left_anti").select("view", "output", "source", "steps")


class LineageStore:
    """Stored tables with their edges beside them: ``tables/<view>`` and ``edges/<view>`` below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def save(self, df: DataFrame, view: str) -> DataFrame:
        """Writes the frame and its edges; gives it back as read from there, tagged as ``view``."""
        # Without column metadata: the edges tell where the columns come from, also after a view they come from is rewritten.
        bare = df.select(*[col(c).alias(c, metadata={}) for c in df.columns])
        bare.write.mode("overwrite").parquet(f"{self.folder}/tables/{view.lower()}")
        lineage_edges(df, view).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/edges/view_name={view.lower()}")
        return self.table(view)

    def table(self, view: str) -> DataFrame:
        return tag_source(self.spark.read.parquet(f"{self.folder}/tables/{view.lower()}"), view)

    def edges(self) -> DataFrame:
        return self.spark.read.schema(EDGE_SCHEMA).parquet(f"{self.folder}/edges")
