"""Types of the data model: vertices, edges, state, data centers, and the fixed tables that go with them."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

EDGE = T.StructType([
    T.StructField("edge_id", T.LongType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("weight", T.DoubleType()),
    T.StructField("obs", T.DoubleType()), T.StructField("edge_type", T.StringType()),
])
EDGE_LINE = T.StructType([
    T.StructField("source", T.LongType()), T.StructField("target", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("obs", T.DoubleType()),
    T.StructField("type", T.StringType()), T.StructField("_corrupt", T.StringType()),
])
POINT = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType())])


class Mode(IntEnum):
    """How supersteps are run; only the first is implemented."""

    SYNCHRONOUS = 0
    ASYNCHRONOUS = 1


class Status(IntEnum):
    DEACTIVATED = 0
    ACTIVATED = 1


#: Places in order, and the upload prices of those whose price differs from the usual one.
REGIONS = [
    "useast", "uswest_oregon", "uswest_northcalifornia", "eu_ireland", "ap_singapore", "ap_tokyo", "ap_sydney", "saeast",
    *(f"sim{i}" for i in range(1, 13)), "east_asia", "jp_west", "west_eu", "east_us",
]
UPLOAD_PRICE = {"ap_singapore": 0.09, "ap_tokyo": 0.09, "ap_sydney": 0.14, "saeast": 0.16}
USUAL_PRICE, UPLOAD_BAND, DOWNLOAD_BAND = 0.02, 100.0, 500.0
#: The five centers' ranks of priority, and the size of a message or vertex state in MB.
PRIORITY = [2, 3, 1, 3, 3]
MESSAGE_MB = 0.000008


def regions(spark: SparkSession) -> DataFrame:
    """location_id, region, upload_price, upload_band, download_band: 24 rows."""
    rows = [(i, r, UPLOAD_PRICE.get(r, USUAL_PRICE), UPLOAD_BAND, DOWNLOAD_BAND) for i, r in enumerate(REGIONS)]
    return spark.createDataFrame(rows, "location_id int, region string, upload_price double, upload_band double, download_band double")


def datacenters(spark: SparkSession) -> DataFrame:
    """dc_id, region, pri_rank: five rows."""
    return spark.createDataFrame([(i, REGIONS[i], p) for i, p in enumerate(PRIORITY)], "dc_id int, region string, pri_rank int")
