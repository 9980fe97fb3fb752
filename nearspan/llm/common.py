"""What the operators of this subpackage share: tables, shared storage, Arrow text views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.tables import discard, materialise, shared_dir

__all__ = ["chunks", "columns_without", "discard", "fresh", "materialise", "shared_dir", "small_batches", "table", "views", "with_fields"]

#: Rows in one Arrow batch; with texts of some kB this keeps a batch at a few MB.
BATCH_ROWS = "4000"
BATCH_BYTES = "8m"
#: Bytes of text that the numpy kernels work on at once.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by rows and bytes before a plan with Python functions is made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def views(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary Arrow array, without a copy. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n, large = len(column), pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES):
    """Row ranges (a, b) with at most `most` bytes each; a longer row stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def columns_without(df: DataFrame, *taken: str) -> list[str]:
    """Columns of df whose names clash with none of those taken (case is ignored)."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def fresh(name: str, *frames: DataFrame) -> str:
    """name, with underscores before it until no column of frames is called so (case is
    ignored)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """Schema of df followed by the columns of a DDL list."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
