"""PageRank whose messages between data centers are combined, clipped, quantized and noised.

The protocol is this package's own; only its parts (noisy k-means, noisy index,
budget parameters) are given.  In every superstep, for messages that cross
centers: combine per sending center and receiver, clip, cluster the values of
each sending center with half of the step's budget (from the centroids of the
step before), replace each message by the centroid at its noisy index with the
other half, then gather and apply as usual.  Messages within a center pass as
they are.  Values are rounded to nine decimals before clustering, so that the
order in which a sum was added can't decide between two equally near centroids.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..graph import Graph
from ..operators.datacenters import combined, located_edges
from ..operators.kmeans1d import even, levels, lloyd, noise_deviation, noisy_index
from ..operators.programs import clamped, pagerank
from .superstep import started


@dataclass(frozen=True)
class PrivacyConfig:
    budget: float = 1.0
    bits: int = 2
    bound: float = 0.5
    centroid_share: float = 0.5
    seed: str = "private"
    centers: int = 5


def private_pagerank(graph: Graph, privacy: PrivacyConfig | None = None, iterations: int = 10) -> DataFrame:
    """id, rank, last_change (and the vertices' columns) after the supersteps."""
    p = privacy or PrivacyConfig()
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("out_degree"))
    edges = checkpointed(located_edges(graph, p.centers).join(out, "src"))
    program, state = pagerank(), started(graph, pagerank())
    centroids = {g: even(levels(p.bits), 0.0, p.bound) for g in range(p.centers)}
    for step in range(iterations):
        sent = edges.join(state.select("id", "rank"), F.col("src") == F.col("id")).select("src_dc", "dst", "dst_dc", (F.col("rank") / F.col("out_degree")).alias("value"))
        near = sent.where("src_dc = dst_dc").select("dst", "value")
        far = combined(sent.where("src_dc <> dst_dc")).withColumn("x", F.round(clamped(F.col("value"), 0.0, p.bound), 9))
        far = checkpointed(far.select(F.col("src_dc").alias("group_id"), "dst", "x"))
        share = p.budget / iterations
        sigma = noise_deviation(0.0, p.bound, share * p.centroid_share)
        centroids = lloyd(far, centroids, 0.0, p.bound, sigma, f"{p.seed}|{step}").centroids
        value = F.lit(None).cast("double")
        for g, cs in centroids.items():
            if cs:
                chosen = noisy_index(F.col("x"), cs, share * (1 - p.centroid_share), f"{p.seed}|{step}", F.concat_ws("|", "group_id", "dst"))
                table = F.create_map(*[F.lit(v) for c, x in sorted(cs.items()) for v in (c, float(x))])
                value = F.when(F.col("group_id") == g, table[chosen]).otherwise(value)
        # a center all of whose clusters died sends nothing
        quantized = far.select("dst", value.alias("value")).where("value is not null")
        got = near.union(quantized).groupBy("dst").agg(F.sum("value").alias("_f"))
        state = state.join(got, F.col("id") == F.col("dst"), "left").drop("dst").withColumn("_f", F.coalesce("_f", F.lit(0.0)))
        state = checkpointed(state.withColumns(program.apply()).drop("_f"))
    return state
