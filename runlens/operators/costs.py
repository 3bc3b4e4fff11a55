"""Energy costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def energy_cost(df: DataFrame, costs: DataFrame) -> DataFrame:
    """J-07. Add ``eur_per_hour`` by (gpu_type, n_gpus); NULL where no price is listed."""
    return df.join(costs, ["gpu_type", "n_gpus"], "left")


def config_cost(claims: DataFrame, costs: DataFrame) -> DataFrame:
    """A-12. Cost of each measured result: its hours times the price of its GPUs.

    An extension: it combines the measured duration with the price list. A configuration with
    a type or count that has no price has no cost.
    """
    measured = claims.where(F.col("duration_seconds").isNotNull())
    parts = measured.select(
        "job_id", "config_key", "duration_seconds", F.explode("gpu_config").alias("gpu_type", "n_gpus")
    )
    priced = energy_cost(parts, costs)
    total = priced.groupBy("job_id", "config_key", "duration_seconds").agg(
        F.sum("eur_per_hour").alias("_sum"), F.bool_and(F.col("eur_per_hour").isNotNull()).alias("_priced")
    )
    rate = F.when(F.col("_priced"), F.col("_sum"))
    return total.select(
        "job_id",
        "config_key",
        "duration_seconds",
        rate.alias("eur_per_hour"),
        (F.col("duration_seconds") / 3600 * rate).alias("cost_eur"),
    )
