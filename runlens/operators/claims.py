"""Updates of the profiling results. Each gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.plans.ordered import first_by
from runlens.schemas import GPU_CONFIG

KEY = ["job_id", "config_key"]
Order = list[str | Column]


def merge_claims(existing: DataFrame, new: DataFrame, order: Order) -> DataFrame:
    """K-01. Add claims whose (type, configuration) is not taken; the first of ``new`` wins."""
    return existing.unionByName(admitted_claims(existing, new, order), allowMissingColumns=True)


def admitted_claims(existing: DataFrame, new: DataFrame, order: Order) -> DataFrame:
    """The rows of ``new`` that K-01 adds. The configuration follows from its key, so it is not
    carried along."""
    first = first_by(new.drop("gpu_config"), KEY, order).join(existing.select(*KEY), KEY, "left_anti")
    if "gpu_config" in new.columns:
        first = first.withColumn("gpu_config", F.from_json("config_key", GPU_CONFIG))
    return first


def complete_claims(claims: DataFrame, results: DataFrame, order: Order) -> DataFrame:
    """K-02. Set duration and node of claims in flight; a later result of the same claim, and
    a result of a completed one, is ignored."""
    found = first_by(results.drop("gpu_config"), KEY, order).select(*KEY, F.struct("node_id", "duration_seconds").alias("_result"))
    taken = F.col("duration_seconds").isNull() & F.col("_result").isNotNull()

    def updated(name: str) -> Column:
        return F.when(taken, F.col("_result")[name]).otherwise(F.col(name)).alias(name)

    changed = {"node_id", "duration_seconds"}
    columns = [updated(c) if c in changed else F.col(c) for c in claims.columns]
    return claims.join(found, KEY, "left").select(*columns)


def release_claims(claims: DataFrame, failed: DataFrame) -> DataFrame:
    """K-03. Drop claims in flight of failed profiling runs, so that they can be retried."""
    in_flight = failed.select(*KEY).distinct().withColumn("_open", F.lit(True))
    match = (
        (claims["job_id"] == in_flight["job_id"])
        & (claims["config_key"] == in_flight["config_key"])
        & claims["duration_seconds"].isNull()
    )
    return claims.join(in_flight, match, "left_anti")


def claims_per_instance(instances: DataFrame, claims: DataFrame) -> DataFrame:
    """A-06. Number of claims each job instance made, 0 when none."""
    counted = claims.groupBy(F.col("instance_id").alias("id")).agg(F.count(F.lit(1)).alias("n_claims"))
    return instances.join(counted, "id", "left").withColumn(
        "n_claims", F.coalesce("n_claims", F.lit(0).cast("bigint"))
    )
