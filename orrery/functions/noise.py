"""Random variates that a seed and keys fix, whatever the partitions and retries.

A seed that others know gives no privacy: keep it secret where noise protects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(seed: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1), from 52 bits of a digest of the seed and keys; never 0 or 1."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") if isinstance(k, Column) else F.lit(k) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def uniform_between(low: float, high: float, seed: str, *keys: Column | str) -> Column:
    return F.lit(low) + F.lit(high - low) * uniform(seed, *keys)


def laplace(mu: Column | float, sigma: Column | float, u: Column, parameter: str = "deviation") -> Column:
    """Laplace by the inverse distribution function at u in (0, 1).

    ``sigma`` is the standard deviation (scale sigma / sqrt 2); with
    ``parameter="scale"`` it is the scale, as the usual mechanism has it.
    """
    mu, sigma = (x if isinstance(x, Column) else F.lit(float(x)) for x in (mu, sigma))
    b = sigma if parameter == "scale" else sigma / F.sqrt(F.lit(2.0))
    v = u - 0.5
    return mu - b * F.signum(v) * F.ln(1 - 2 * F.abs(v))


#: Tries of ``gamma_variate``; each is accepted in more than 19 of 20 cases.
TRIES = 12


def gamma_variate(shape: float, scale: float, seed: str, *keys: Column | str) -> Column:
    """Gamma by Marsaglia and Tsang's squeeze of a cubed normal variate; the first try that is accepted counts.

    Under shape 1, a variate of shape + 1 times a power of a uniform one.
    """
    if shape <= 0 or scale <= 0:
        raise ValueError("shape and scale must be positive")
    d = (shape if shape >= 1 else shape + 1) - 1 / 3
    c = 1 / (9 * d) ** 0.5
    found = []
    for t in range(TRIES):
        u1, u2, u3 = (uniform(seed, *keys, f"{t}{x}") for x in "abc")
        normal = F.sqrt(-2 * F.ln(u1)) * F.cos(2 * F.lit(3.141592653589793) * u2)
        root = 1 + c * normal
        v = root * root * root
        found.append(F.when((root > 0) & (F.ln(u3) < 0.5 * normal * normal + d - d * v + d * F.ln(F.when(root > 0, v).otherwise(1.0))), d * v))
    out = F.coalesce(*found, F.lit(d)) * scale  # all tries fail in fewer than one of 10^15 rows
    return out if shape >= 1 else out * F.pow(uniform(seed, *keys, "power"), F.lit(1 / shape))


def gamma(df: DataFrame, shape: float, scale: float, seed_col: str, out: str) -> DataFrame:
    """Gamma variates, the same for the same whole seed."""
    return df.withColumn(out, gamma_variate(shape, scale, "gamma", F.col(seed_col).cast("long")))


def pdf_to_cdf(df: DataFrame, value: str, order: str, groups: int = 256) -> DataFrame:
    """``cdf``: running sum by ``order`` over the total, in two levels: sums of ranges of rows first, then within them."""
    ranged = df.withColumn("_g", F.floor(F.col(order) / groups).cast("long"))
    sums = ranged.groupBy("_g").agg(F.sum(value).alias("_s"))
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_s").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "_total": F.sum("_s").over(W.partitionBy())})
    own = F.sum(value).over(W.partitionBy("_g").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", own).join(sums.drop("_s"), "_g").withColumn("cdf", (F.col("_before") + F.col("_own")) / F.col("_total")).drop("_g", "_own", "_before", "_total")


def multinomial_stub() -> Column:
    """What the declared draw returns, whatever the distribution: 1."""
    return F.lit(1).cast("long")


def multinomial(cdf: DataFrame, u: float, order: str) -> DataFrame:
    """A working draw: the first row whose ``cdf`` exceeds u."""
    return cdf.where(F.col("cdf") > u).agg(F.min(order).alias(order))
