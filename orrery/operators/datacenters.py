"""Graphs over several data centers: budget shares, placement, combining and traffic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..graph import Graph
from ..schema import MESSAGE_MB, datacenters, regions


def budget_shares(centers: DataFrame) -> DataFrame:
    """dc_id, pri_rank, budget_weight (centers of lower priority rank), budget_sum, budget_share; shares are null if all ranks are equal.

    The table of centers is small by nature (one row each).
    """
    weighed = centers.withColumn("budget_weight", F.rank().over(W.orderBy("pri_rank")).cast("long") - 1)
    total = weighed.withColumn("budget_sum", F.sum("budget_weight").over(W.partitionBy()))
    share = F.when(F.col("budget_sum") != 0, F.col("budget_weight") / F.when(F.col("budget_sum") == 0, F.lit(1)).otherwise(F.col("budget_sum")).cast("double"))
    return total.select("dc_id", "pri_rank", "budget_weight", "budget_sum", share.alias("budget_share"))


def placed(graph: Graph, centers: int = 5) -> DataFrame:
    """(id, dc_id): the vertex's location, or its id modulo the number of centers where it has none."""
    return graph.vertices.select("id", F.coalesce(F.col("location_id"), F.pmod("id", F.lit(centers))).cast("int").alias("dc_id"))


def located_edges(graph: Graph, centers: int = 5) -> DataFrame:
    """src, dst, src_dc, dst_dc."""
    at = placed(graph, centers)
    src, dst = (at.select(F.col("id").alias(e), F.col("dc_id").alias(f"{e}_dc")) for e in ("src", "dst"))
    return graph.edges.select("src", "dst").join(src, "src").join(dst, "dst").select("src", "dst", "src_dc", "dst_dc")


def combined(sent: DataFrame) -> DataFrame:
    """One message per sending center and receiver: src_dc, dst, dst_dc, value, n_messages.  ``sent`` has src_dc, dst, dst_dc, value."""
    return sent.groupBy("src_dc", "dst", "dst_dc").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_messages"))


def combined_sources(sent: DataFrame) -> DataFrame:
    """The same with the senders of each message, sorted; ``sent`` has src too."""
    return sent.groupBy("src_dc", "dst", "dst_dc").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n_messages"), F.array_sort(F.collect_list("src")).alias("sources"))


def traffic(edges: DataFrame) -> DataFrame:
    """Between centers: src_dc, dst_dc, n_messages, n_combined (one per receiver), mb, mb_combined."""
    across = edges.where("src_dc <> dst_dc").groupBy("src_dc", "dst_dc", "dst").agg(F.count(F.lit(1)).alias("n"))
    sums = across.groupBy("src_dc", "dst_dc").agg(F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_combined"))
    return sums.withColumns({"mb": F.col("n_messages") * MESSAGE_MB, "mb_combined": F.col("n_combined") * MESSAGE_MB})


def traffic_totals(edges: DataFrame) -> DataFrame:
    """dc_id, upload_mb, download_mb, upload_cost by the price of its region."""
    spark = edges.sparkSession
    between = traffic(edges)
    up = between.groupBy(F.col("src_dc").alias("dc_id")).agg(F.sum("mb").alias("upload_mb"))
    down = between.groupBy(F.col("dst_dc").alias("dc_id")).agg(F.sum("mb").alias("download_mb"))
    price = regions(spark).select(F.col("location_id").alias("dc_id"), "upload_price")
    all_ = datacenters(spark).select("dc_id").join(up, "dc_id", "left").join(down, "dc_id", "left").join(price, "dc_id").fillna(0.0, ["upload_mb", "download_mb"])
    return all_.select("dc_id", "upload_mb", "download_mb", (F.col("upload_mb") * F.col("upload_price")).alias("upload_cost"))


def collected(messages: DataFrame, key: str, value: str, item: str) -> DataFrame:
    """Items by key in the order of their value, as the collector of messages holds them."""
    return messages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(item).alias("i")))), lambda s: s["i"]).alias("items"))
