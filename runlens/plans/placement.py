"""Where each waiting job would be placed.

The rules look sequential: jobs are taken oldest first and each claim made affects the next job
of the same type. They have an exact set form, because capacity does not change within a round
and the only state handed on is the claim list of the type. With ``rem`` the type's un-profiled
configurations in order, ``k`` the first of them no profiling node can take, and ``r`` the rank
of the job among those of its type still allowed to profile:

* nothing left to profile, or the job used up its claims: standard run;
* ``k`` exists: profile ``rem[min(r, k)]``. The one that cannot be placed is never claimed and so
  holds up the type: later jobs get the same one, without a node;
* else ``r < size(rem)``: profile ``rem[r]``; otherwise standard run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.operators.capacity import gpu_usage, node_free
from runlens.operators.claims import claims_per_instance
from runlens.operators.configs import (
    available_config,
    blocked_places,
    claimed_places,
    fitting_configs,
    open_gaps,
    open_places,
    rank_configs,
    valid_configs,
)
from runlens.operators.filters import waiting
from runlens.plans.ordered import DEFAULT, HotGroups, join_unique, row_number, with_ordered
from runlens.schemas import GPU_CONFIG


def plan_round(
    jobs: DataFrame,
    claims: DataFrame,
    nodes: DataFrame,
    limit: int = C.PROFILING_CONFIGS_PER_JOB,
    hot: HotGroups = DEFAULT,
) -> DataFrame:
    """P-01. (id, job_id, mode, config_key, node_id, is_profiling_run) per waiting job.

    Fit is decided per configuration and what is left to profile per type; only the rank (W-06)
    and the final join run over the jobs. A type with very many waiting jobs is ranked in
    chunks and spread over the final join.
    """
    free = node_free(nodes, gpu_usage(jobs))
    queued = waiting(jobs).select("id", "job_id", "created_at")
    # One scan for both kinds of job: those that may not profile rank in a group of their own.
    ranked = with_ordered(
        claims_per_instance(queued, claims).withColumn("_open", F.col("n_claims") < limit),
        ["job_id", "_open"],
        ["created_at", "id"],
        {"r": row_number()},
        hot,
        cut_by=(queued, ["job_id"]),
    ).withColumn("r", F.col("r") - 1)

    configs = valid_configs(nodes)
    fits = fitting_configs(configs, free, profiling_only=True).select("config_key", F.col("node_id").alias("fit_node"))
    placed = rank_configs(configs.select("config_key", "n_gpus")).join(fits, "config_key", "left")
    held = claimed_places(claims, placed)
    types = queued.groupBy("job_id").agg(F.count(F.lit(1)).alias("most"))
    # No type needs more open configurations than it has waiting jobs.
    gaps = open_gaps(types, placed, held).join(types, "job_id")
    rem = open_places(gaps).join(placed, "place").select("job_id", "r", F.struct("config_key", "fit_node").alias("rem"))
    standard = available_config(queued, claims, free).select("job_id", F.struct("config_key", "node_id").alias("std"))
    by_type = standard.join(blocked_places(types, placed, claims, held), "job_id", "left")

    # Ranks are unique in a type, so no (type, rank) is hot; a blocked type has its one configuration with it.
    judged = join_unique(ranked, by_type, ["job_id"], hot, counted=queued).join(rem, ["job_id", "r"], "left")
    blocked = F.coalesce(F.col("r") >= F.col("k"), F.lit(False))
    profile = F.col("_open") & (blocked | F.col("rem").isNotNull())
    key = F.when(blocked, F.col("k_config")).otherwise(F.col("rem.config_key"))
    node = F.when(~blocked, F.col("rem.fit_node"))
    return judged.withColumn("is_profiling_run", profile).select(
        "id",
        "job_id",
        F.when(profile, "profiling").otherwise("standard").alias("mode"),
        F.when(profile, key).otherwise(F.col("std.config_key")).alias("config_key"),
        F.when(profile, node).otherwise(F.col("std.node_id")).alias("node_id"),
        "is_profiling_run",
    )


def planned_claims(plan: DataFrame, now: Column) -> DataFrame:
    """The claims a plan makes, for K-01: one per profiling run that got a node."""
    made = plan.where(F.col("is_profiling_run") & F.col("node_id").isNotNull())
    return made.select(
        "job_id",
        F.col("id").alias("instance_id"),
        F.from_json("config_key", GPU_CONFIG).alias("gpu_config"),
        "config_key",
        "node_id",
        F.lit(None).cast("double").alias("duration_seconds"),
        now.alias("created_at"),
    )


def plan_standard(jobs: DataFrame, claims: DataFrame, nodes: DataFrame, hot: HotGroups = DEFAULT) -> DataFrame:
    """P-02. Every waiting job as a standard run, on its type's first available configuration."""
    free = node_free(nodes, gpu_usage(jobs))
    queue = waiting(jobs).select("id", "job_id")
    found = available_config(queue, claims, free)
    return join_unique(queue, found, ["job_id"], hot).select(
        "id", "job_id", F.lit("standard").alias("mode"), "config_key", "node_id", F.lit(False).alias("is_profiling_run")
    )
