"""How much text goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches in bytes: Spark's own bound of 10,000 rows says nothing of long texts.

    A session that already asks for less keeps its setting.
    """
    now = int(spark.conf.get(SETTING).removesuffix("b"))
    if now <= 0 or now > most:
        spark.conf.set(SETTING, str(most))
