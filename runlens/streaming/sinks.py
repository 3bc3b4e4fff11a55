"""Running a stream into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BatchHandler = Callable[[DataFrame, int], None]


def batch_folder(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch}"


def write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """Write a micro-batch to its own folder. A batch that is run again after a failure
    overwrites what its first try left."""
    rows.write.mode("overwrite").parquet(batch_folder(folder, batch))


def start(
    stream: DataFrame,
    handler: BatchHandler,
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a stream into ``handler``; ``every`` is a trigger interval such as ``60 seconds``,
    and without it the stream stops once it has read what there is."""
    writer = stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).outputMode(mode)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def start_to_folder(
    stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", every: str | None = None
) -> StreamingQuery:
    """Start a stream into one folder per micro-batch below ``folder``."""
    return start(stream, lambda rows, batch: write_batch(rows, folder, batch), checkpoint, mode, every)


def start_to_table(stream: DataFrame, folder: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start an append stream into Parquet files that another stream can read, each row once."""
    writer = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def newest_rows(updates: DataFrame, keys: list[str], newest: list[Column]) -> DataFrame:
    """The current row per key of a folder of updates. Combined before the shuffle, so a key
    updated very often costs no more than another."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    latest = F.max_by(F.struct(*values), F.struct(*newest)).alias("_row")
    return updates.groupBy(*keys).agg(latest).select(*keys, "_row.*")
