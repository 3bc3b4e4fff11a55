"""Dropping rows that arrive more than once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.streaming.sinks import BatchHandler, write_batch


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """A folder of micro-batches, or None when nothing was written yet."""
    try:
        return spark.read.parquet(folder)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def first_arrivals_handler(folder: str, keys: list[str], time: str = "ts") -> BatchHandler:
    """Keep the first row per key that arrives, however late it is; repeats are dropped.

    No watermark decides, so no first row is lost. Each micro-batch is reduced to one row per key, the earliest
    by ``time``, combined before the shuffle, and compared with the keys of the batches before it, of which only
    the key columns are read. A batch that runs again after a failure gives the same.
    """

    def handle(rows: DataFrame, batch: int) -> None:
        values = [c for c in rows.columns if c not in keys]
        order = F.struct(time, *[c for c in values if c != time])
        first = rows.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_row"))
        first = first.select(*keys, "_row.*").select(*rows.columns)
        before = stored(rows.sparkSession, folder)
        if before is not None:
            known = before.where(F.col("batch") < batch).select(*keys)
            first = first.join(known, keys, "left_anti")
        write_batch(first, folder, batch)

    return handle
