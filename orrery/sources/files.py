"""Text sources and sinks: edge lists, point files, results, and run times."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE_LINE, POINT

log = logging.getLogger(__name__)

#: The datasets known by name, with their numbers of vertices and edges.
DATASETS = {"bitcoinotc": (5881, 35592), "bitcoinalpha": (3783, 24186)}


def dataset(name: str, folder: str) -> tuple[str, int, int]:
    """Path, vertices and edges of a named dataset; an unknown name is an error."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known are {', '.join(DATASETS)}")
    return (f"{folder}/{name}.csv", *DATASETS[name])


def edge_list(spark: SparkSession, path: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(edges, malformed lines) of a file of source, target, weight, obs, type; the last three may be missing.

    A line counts if it has both ends; parsing is Spark's own, with a fixed schema.
    """
    raw = spark.read.schema(EDGE_LINE).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    ends = F.col("source").isNotNull() & F.col("target").isNotNull()
    # a line that only lacks its last fields is whole as far as it goes
    short = F.size(F.split("_corrupt", f"[{sep}]")) < 5
    good = ends & (F.col("_corrupt").isNull() | short)
    edges = raw.where(good).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("obs", F.lit(0.0)).alias("obs"), F.coalesce("type", F.lit("")).alias("edge_type"))
    return edges, raw.where(~good)


def point_file(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """(id, x) of lines of a vertex, a separator and a value; values are not clipped."""
    return spark.read.schema(POINT).option("sep", sep).option("mode", "DROPMALFORMED").csv(path).where(F.col("id").isNotNull() & F.col("x").isNotNull())


def write_edge_list(edges: DataFrame, path: str, sep: str = ",") -> None:
    edges.select("src", "dst", "weight", "obs", "edge_type").write.option("sep", sep).csv(path)


def write_result(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Logs start, end and the seconds used."""
    began = time.perf_counter()
    log.info("%s: started", what)
    try:
        yield
    finally:
        log.info("%s: used %.1f s", what, time.perf_counter() - began)
