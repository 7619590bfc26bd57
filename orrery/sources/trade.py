"""A directed graph over customers from the trade tables, and points for clustering.

A customer points to the customer whose key is the part key of a returned line,
modulo the number of customers; weights lie in [-5, 5] like ratings of trust.
Regions are the data centers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, numbered


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight, obs: one row per ordered pair."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_discount", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    n = read(spark, sf_dir, "customer").count()
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("dst", F.col("l_partkey") % F.lit(n)).where("o_custkey <> dst")
    return pairs.groupBy(F.col("o_custkey").alias("src"), "dst").agg(F.round(F.avg(F.round(F.col("l_discount") * 100) - 5), 6).alias("weight"), F.round(F.sum("l_quantity"), 6).alias("obs"))


def trade_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, location_id, is_seed."""
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    seed = (F.col("c_acctbal") < 0) & (F.col("c_mktsegment") == "BUILDING")
    return read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("location_id"), seed.alias("is_seed"))


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(trade_vertices(spark, sf_dir), trade_edges(spark, sf_dir))


def trade_graph_numbered(spark: SparkSession, sf_dir: str) -> Graph:
    """The same with edge_id by (src, dst) and a type."""
    edges = numbered(trade_edges(spark, sf_dir), ["src", "dst"], "edge_id").withColumn("edge_type", F.lit("trade"))
    return Graph(trade_vertices(spark, sf_dir), edges)


def price_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x: prices of lines, scaled into [0, 0.5]."""
    by = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = numbered(read(spark, sf_dir, "lineitem").select(*by), by, "id")
    return rows.select("id", F.least(F.greatest(F.col("l_extendedprice") / F.lit(210000.0), F.lit(0.0)), F.lit(0.5)).alias("x"))
