"""Helpers shared by the operators: tables and Arrow text batches; checkpoints are the library's own."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..checkpoints import checkpointed, discarded, released, shared_dir, stored

__all__ = ["CHUNK_BYTES", "checkpointed", "chunks", "discarded", "released", "shared_dir", "stored", "strings", "table"]

#: Bytes of text handled together by numpy code; bounds a worker's memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most`` bytes; a longer value comes alone, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.nan_to_num(np.asarray(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=float))
        start, held = 0, 0.0
        for i, size in enumerate(sizes):
            if i > start and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0.0
            held += size
        yield batch.slice(start)


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a string column, null as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]
