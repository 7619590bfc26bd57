"""Directed graphs as two DataFrames, and what can be asked of their structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .checkpoints import checkpointed


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 by ``order``, in ranges: no task sees more than its range.

    Ranges are kept (checkpointed) before they are counted, so that numbers
    don't depend on a second sampling of the ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_own", own).join(before, "_part").withColumn(name, (F.col("_own") - 1 + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


@dataclass(frozen=True)
class Graph:
    """``vertices`` has id (and location_id, is_seed); ``edges`` has src, dst (and edge_id and attributes).

    Edges are unique per ordered pair; use ``unique_edges`` where they may not be.
    """

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def blank(spark: SparkSession, n: int, edges: DataFrame) -> Graph:
        """n vertices without attributes, numbered from 0."""
        return Graph(spark.range(n).select("id", F.lit(None).cast("int").alias("location_id"), F.lit(False).alias("is_seed")), edges)

    def unique_edges(self) -> Graph:
        """One edge per ordered pair, the one with the smallest attributes."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        if not rest:
            return Graph(self.vertices, self.edges.distinct())
        one = self.edges.groupBy("src", "dst").agg(F.min(F.struct(*rest)).alias("_r"))
        return Graph(self.vertices, one.select("src", "dst", "_r.*"))

    def degrees(self, end: str) -> DataFrame:
        """(id, degree) by ``end``: "src" counts outgoing edges, "dst" incoming ones; 0 where there are none."""
        counts = self.edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.vertices.select("id").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))

    def neighbours(self, end: str) -> DataFrame:
        """(id, neighbours), sorted: targets for "src", sources for "dst"; vertices without any have an empty list."""
        other = "dst" if end == "src" else "src"
        lists = self.edges.groupBy(F.col(end).alias("id")).agg(F.array_sort(F.collect_list(other)).alias("neighbours"))
        return self.vertices.select("id").join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<long>")))

    def edge(self, src: int, dst: int) -> DataFrame:
        """The attributes of an edge; a filter that reaches the scan."""
        return self.edges.where((F.col("src") == src) & (F.col("dst") == dst))

    def edge_by_id(self, edge_id: int) -> DataFrame:
        return self.edges.where(F.col("edge_id") == edge_id).select("edge_id", "src", "dst")

    def edge_attributes(self, pairs: DataFrame) -> DataFrame:
        """Attributes of many (src, dst) pairs at once."""
        return pairs.join(self.edges, ["src", "dst"])

    def with_degrees(self) -> DataFrame:
        """The edges with out_degree of their source and in_degree of their target."""
        out = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
        into = self.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("in_degree"))
        return self.edges.select("src", "dst").join(out, "src").join(into, "dst")
