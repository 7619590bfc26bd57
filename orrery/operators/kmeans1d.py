"""Noisy one-dimensional k-means per group, and the noisy choice of a centroid.

Centroids are few (levels x groups, at most 2^bits for each of the data
centers), so they are the one thing that returns to the driver each round; the
points never do.  Each round is one aggregation with partial sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.noise import laplace, uniform
from .programs import clamped

ROUNDS = 5
Centroids = dict[int, dict[int, float]]  # by group, by cluster; a dead cluster is absent


def levels(bits: int) -> int:
    return 2**bits


def noise_deviation(low: float, high: float, budget: float) -> float:
    """The deviation of the noise of one round: the range plus one, times the rounds, over the budget; none for a budget of 0."""
    return (high - low + 1) * ROUNDS / budget if budget else 0.0


def squared_distance(x: Column, c: Column | float) -> Column:
    d = x - (c if isinstance(c, Column) else F.lit(float(c)))
    return d * d


def nearest(x: Column, group: Column, centroids: Centroids) -> Column:
    """The closest cluster of the point's group, the lowest of equals; null if the group has none."""
    def of(cs: dict[int, float]) -> Column:
        near = F.array_min(F.array(*[F.struct(squared_distance(x, c).alias("d"), F.lit(k).alias("c")) for k, c in sorted(cs.items())]))
        return near["c"]

    out = F.lit(None).cast("int")
    for g, cs in centroids.items():
        if cs:
            out = F.when(group == g, of(cs)).otherwise(out)
    return out


@dataclass(frozen=True)
class Clustered:
    """``assigned`` are the points with their cluster, by the centroids before the last update; ``sizes`` what that update counted, noise included."""

    assigned: DataFrame
    centroids: Centroids
    sizes: dict[int, dict[int, int]]


def lloyd(points: DataFrame, start: Centroids, low: float, high: float, sigma: float, seed: str, rounds: int = ROUNDS) -> Clustered:
    """``points`` has group_id and x.  Counts and sums get Laplace noise; means are clipped to the bounds.

    A count is truncated after its noise; a count of 0 sends the mean to the
    bound that its sum points to, and 0/0 or no point at all kills the cluster
    for good.
    """
    centroids, sizes, used = {g: dict(c) for g, c in start.items()}, {}, start
    for r in range(rounds):
        used = centroids
        sums = (
            points.withColumn("c", nearest(F.col("x"), F.col("group_id"), used))
            .where("c is not null")
            .groupBy("group_id", "c")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"))
        )
        keys = F.concat_ws("|", F.lit(str(r)), F.col("group_id"), F.col("c"))
        noisy = sums.select(
            "group_id", "c",
            (F.col("n") + laplace(0.0, sigma, uniform(seed, keys, "count"))).cast("long").alias("n"),
            (F.col("s") + laplace(0.0, sigma, uniform(seed, keys, "sum"))).alias("s"),
        )
        mean = (
            F.when(F.col("n") != 0, F.col("s") / F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("n")))
            .when(F.col("s") > 0, F.lit(high))
            .when(F.col("s") < 0, F.lit(low))
        )
        found = noisy.select("group_id", "c", "n", clamped(mean, low, high).alias("x")).collect()  # at most levels x groups rows
        centroids = {g: {} for g in start}
        sizes = {g: {} for g in start}
        for row in found:
            if row["x"] is not None:
                centroids[row["group_id"]][row["c"]] = row["x"]
                sizes[row["group_id"]][row["c"]] = row["n"]
    return Clustered(points.withColumn("c", nearest(F.col("x"), F.col("group_id"), used)), centroids, sizes)


def as_rows(spark, centroids: Centroids) -> DataFrame:
    rows = [(g, c, x) for g, cs in centroids.items() for c, x in cs.items()]
    return spark.createDataFrame(rows, "group_id int, c int, x double")


def even(k: int, low: float, high: float) -> dict[int, float]:
    """Centroids in the middle of k equal parts of the range."""
    return {c: low + (high - low) * (c + 0.5) / k for c in range(k)}


def seeded(points: DataFrame, k: int, seed: str, parity: bool = False, block: int = 4096) -> dict[int, float]:
    """k-means++ over ``points`` (id from 0 without gaps, x).

    The first centroid is a random point; each next one is the first point, by
    id, where the running sum of squared distances to the nearest centroid so
    far reaches a random share of the total and whose value isn't used yet.
    Sums are two-level, so no task holds all points.  With ``parity`` the value
    0 counts as used from the start.
    """
    points = checkpointed(points)
    n, spark = points.count(), points.sparkSession
    if not n:
        return {}
    draw = lambda step: spark.range(1).select(uniform(seed, "seed", str(step))).first()[0]
    chosen = [points.where(F.col("id") == min(n - 1, int(draw(0) * n))).first()["x"]]
    for step in range(1, k):
        d = F.array_min(F.array(*[squared_distance(F.col("x"), c) for c in chosen]))
        away = points.select("id", "x", d.alias("d"), F.floor(F.col("id") / block).alias("b"))
        sums = away.groupBy("b").agg(F.sum("d").alias("s")).withColumn("to", F.sum("s").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, 0)))
        total = sums.agg(F.sum("s")).first()[0]
        target = draw(step) * total
        hit = sums.where(F.col("to") >= target).orderBy("b").first()
        if hit is None:
            break
        own = F.sum("d").over(W.partitionBy("b").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
        crossing = away.where(F.col("b") == hit["b"]).withColumn("to", F.lit(hit["to"] - hit["s"]) + own).where(F.col("to") >= target).agg(F.min("id")).first()[0]
        crossing = (hit["b"] + 1) * block if crossing is None else crossing
        used = [*chosen, *[0.0] * parity]
        found = away.where((F.col("id") >= crossing) & ~F.col("x").isin(used)).agg(F.min(F.struct("id", "x")).alias("m")).first()["m"]
        if found is None:
            break
        chosen.append(found["x"])
    return dict(enumerate(chosen))


def noisy_distances(x: Column, centroids: dict[int, float], epsilon: float, seed: str, *keys: Column) -> Column:
    """An array of (c, distance, noise): of each centroid its distance and the Laplace noise of deviation 2 * spread / epsilon."""
    if epsilon <= 0:
        raise ValueError("epsilon must be positive")
    order = sorted(centroids)
    away = [F.abs(x - F.lit(float(centroids[c]))) for c in order]
    spread = (F.greatest(*away) - F.least(*away)) if len(away) > 1 else F.lit(0.0)
    noise = [laplace(0.0, spread * (2.0 / epsilon), uniform(seed, *keys, str(c))) for c in order]
    return F.array(*[F.struct(F.lit(c).alias("c"), d.alias("distance"), n.alias("noise")) for c, d, n in zip(order, away, noise)])


def noisy_index(x: Column, centroids: dict[int, float], epsilon: float, seed: str, *keys: Column) -> Column:
    """Report-noisy-min: the centroid whose distance plus noise is smallest, the lowest of equals."""
    return F.array_min(F.transform(noisy_distances(x, centroids, epsilon, seed, *keys), lambda k: F.struct((k["distance"] + k["noise"]).alias("v"), k["c"].alias("c"))))["c"]


def single(points: DataFrame) -> DataFrame:
    """All points as one group."""
    return points.withColumn("group_id", F.lit(0))


def clipped(points: DataFrame, low: float, high: float) -> DataFrame:
    return points.withColumn("x", clamped(F.col("x"), low, high))


def kmeans(points: DataFrame, k: int, low: float, high: float, budget: float, seed: str, start: dict[int, float] | None = None, parity: bool = False) -> Clustered:
    """Load, clip, seed (unless ``start`` is a warm start) and five noisy rounds; ``points`` has id and x."""
    points = clipped(points, low, high)
    first = start if start is not None else seeded(points, k, seed, parity)
    return lloyd(single(points), {0: first}, low, high, noise_deviation(low, high, budget), seed)


