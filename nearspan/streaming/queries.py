"""Queries that arrive as a stream against a fixed reference: each micro-batch is searched by
the batch plan, so results are the batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def search_stream(stream: DataFrame, search: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends search(batch) of every micro-batch of queries to the table folder `out`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: search(batch).write.mode("append").parquet(out)).trigger(availableNow=True).start()
