"""What nodes hold, what runs use, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators.filters import active_jobs
from runlens.plans.ordered import DEFAULT, HotGroups, join_unique, row_number, with_ordered


def gpu_usage(jobs: DataFrame) -> DataFrame:
    """A-03. GPUs in use per node and type."""
    used = active_jobs(jobs).where(F.col("assigned_gpu_config").isNotNull())
    return (
        used.select(F.col("assigned_node").alias("node_id"), F.explode("assigned_gpu_config").alias("gpu_type", "n"))
        .groupBy("node_id", "gpu_type")
        .agg(F.sum("n").alias("used"))
    )


def node_free(nodes: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per node with ``capacity``, an array of (gpu_type, total, used, free).

    The array is as long as the node's own resource list. Nodes and usage join as they come:
    an inventory can be large, so broadcasting it is left to Spark's check of its size.
    """
    # Usage has one row per node and type, so a node's pairs are a set, as long as it has types in use.
    by_node = usage.groupBy("node_id").agg(
        F.map_from_entries(F.collect_set(F.struct("gpu_type", "used"))).alias("_used")
    )
    joined = nodes.join(by_node, "node_id", "left")
    used = lambda r: F.coalesce(F.col("_used")[r["gpu_type"]], F.lit(0).cast("bigint"))
    return joined.withColumn(
        "capacity",
        F.transform(
            "resources",
            lambda r: F.struct(
                r["gpu_type"].alias("gpu_type"),
                r["gpu_count"].cast("bigint").alias("total"),
                used(r).alias("used"),
                (r["gpu_count"] - used(r)).alias("free"),
            ),
        ),
    ).drop("_used")


def remaining_capacity(nodes: DataFrame, usage: DataFrame) -> DataFrame:
    """J-02. (node_id, gpu_type, total, used, free), for the inventory's own nodes and types.
    More can be in use than there is, so ``free`` may be negative."""
    return node_free(nodes, usage).select("node_id", F.inline("capacity"))


def node_status(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """J-01. Every node with ``busy`` or ``idle`` and the number of its active jobs."""
    running = active_jobs(jobs).groupBy(F.col("assigned_node").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"))
    count = F.coalesce("_n", F.lit(0).cast("bigint"))
    return (
        nodes.join(running, "node_id", "left")
        .withColumn("n_current_jobs", count)
        .withColumn("status", F.when(count > 0, "busy").otherwise("idle"))
        .drop("_n")
    )


def node_job_ids(nodes: DataFrame, jobs: DataFrame, page_size: int = 1000, hot: HotGroups = DEFAULT) -> DataFrame:
    """J-01 with ``current_job_ids``, the sorted ids of each node's active jobs, in pages.

    A node with up to ``page_size`` jobs has the one page 0, empty when it is idle. A larger one
    has more pages, so that no row holds a list without bound.
    """
    running = active_jobs(jobs).select(F.col("assigned_node").alias("node_id"), "id")
    placed = with_ordered(running, ["node_id"], ["id"], {"_place": row_number()}, hot)
    pages = (
        placed.withColumn("page", F.floor((F.col("_place") - 1) / page_size))
        .groupBy("node_id", "page")
        .agg(F.sort_array(F.collect_list("id")).alias("current_job_ids"))
    )
    return nodes.join(pages, "node_id", "left").select(
        *nodes.columns,
        F.coalesce("page", F.lit(0).cast("bigint")).alias("page"),
        F.when(F.col("page").isNull(), "idle").otherwise("busy").alias("status"),
        F.coalesce("current_job_ids", F.array().cast("array<string>")).alias("current_job_ids"),
    )


def node_current_jobs(nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """J-01, one row per node and active job; an idle node has one row with no job."""
    running = active_jobs(jobs).select(F.col("assigned_node").alias("node_id"), F.col("id").alias("current_job_id"))
    known = nodes.select("node_id", F.lit("busy").alias("status"))
    busy = join_unique(running, known, ["node_id"], how="inner").select("node_id", "status", "current_job_id")
    idle = nodes.join(running.select("node_id").distinct(), "node_id", "left_anti").select(
        "node_id", F.lit("idle").alias("status"), F.lit(None).cast("string").alias("current_job_id")
    )
    return busy.unionByName(idle)


def node_counts(status: DataFrame) -> DataFrame:
    """A-02. Totals over ``node_status``."""
    return status.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "busy").alias("busy"),
        F.count_if(F.col("status") == "idle").alias("idle"),
    )


def node_gpu_total(nodes: DataFrame) -> DataFrame:
    """A-04. Add ``total_gpus``."""
    total = F.aggregate("resources", F.lit(0), lambda acc, r: acc + r["gpu_count"])
    return nodes.withColumn("total_gpus", total)


def route_jobs(jobs: DataFrame, nodes: DataFrame) -> DataFrame:
    """J-09. Worker address of each job's node; NULL means the job runs locally."""
    targets = nodes.select(F.col("node_id").alias("assigned_node"), F.col("worker_url").alias("target_url"))
    return join_unique(jobs.select("id", "assigned_node"), targets, ["assigned_node"])


def usage_rollup(jobs: DataFrame) -> DataFrame:
    """A-01 to A-03 at several levels in one pass: GPUs and assignments by node, GPU type and status, by fewer of them, and in all.

    ``level`` is the grouping id: a bit (4, 2, 1 for node, type, status) is set where the column is a total, so a total is told
    from a NULL. Rows are expanded before one shuffle and summed in each task first.
    """
    placed = jobs.where(F.col("assigned_node").isNotNull())
    each = placed.select("assigned_node", F.explode("assigned_gpu_config").alias("gpu_type", "_n"), "status")
    node, kind, status = F.col("assigned_node"), F.col("gpu_type"), F.col("status")
    sets = [[node, kind, status], [node, kind], [node], [kind, status], [kind], [status], []]
    return each.groupingSets(sets, node, kind, status).agg(
        F.grouping_id().cast("int").alias("level"), F.sum("_n").alias("gpus"), F.count(F.lit(1)).alias("assignments")
    )
