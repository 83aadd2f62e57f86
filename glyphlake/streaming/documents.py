"""Pages as a stream (an extension: the operators work page by page, so a micro-batch needs no state)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def each_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes transform(batch) of every micro-batch to folder/batch=N as Parquet, all that is there now and then it stops.

    A batch that is run again after a failure overwrites its own folder, so each counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
