"""Listings: sorting, paging, display columns and dashboard counts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import format_gpu_config, short_id, status_rank


def newest_page(
    jobs: DataFrame, limit: int = C.PAGE_SIZE, offset: int = 0, after: tuple[datetime, str] | None = None
) -> DataFrame:
    """O-01. One page of jobs, newest first.

    ``after`` is the (created_at, id) of the last job of the page before: later pages then cost no more than the
    first. ``offset`` counts rows instead, all of which every task keeps; it is for the first pages.
    """
    if not 1 <= limit <= C.PAGE_SIZE_MAX:
        raise ValueError(f"limit must be between 1 and {C.PAGE_SIZE_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    if after is not None:
        at, last = F.lit(after[0]), F.lit(after[1])
        jobs = jobs.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") > last)))
    return jobs.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def by_duration(claims: DataFrame) -> DataFrame:
    """O-03. Fastest result first, runs in flight last; equal ones by configuration, then type."""
    return claims.orderBy(F.asc_nulls_last("duration_seconds"), "config_key", "job_id")


def by_config_key(configs: DataFrame) -> DataFrame:
    """O-04. Order of the configuration listing."""
    return configs.orderBy("config_key")


def by_size(configs: DataFrame) -> DataFrame:
    """O-04. Order in which configurations are profiled."""
    return configs.orderBy("n_gpus", "config_key")


def table_view(
    df: DataFrame,
    sort_by: str | None = None,
    descending: bool = False,
    filter_column: str | None = None,
    filter_text: str = "",
    page: int = 0,
    page_size: int = C.TABLE_PAGE_SIZE,
    tie_break: str = "id",
) -> DataFrame:
    """O-05. One page of a table, sorted by any column and filtered on another.

    ``tie_break`` gives every row a place of its own, also where no column is sorted by, so pages never overlap.
    """
    if filter_column and filter_text:
        df = df.where(F.lower(F.col(filter_column).cast("string")).contains(filter_text.lower()))
    chosen = [F.desc(sort_by) if descending else F.asc(sort_by)] if sort_by else []
    return df.orderBy(*chosen, tie_break).offset(page * page_size).limit(page_size)


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit(C.MISSING))


def job_listing(jobs: DataFrame) -> DataFrame:
    """S-10. Display columns of the job queue; a missing value is shown as a dash."""
    short_time = "MM/dd HH:mm"
    return jobs.select(
        "id",
        short_id("id").alias("short_id"),
        "image",
        F.array_join("command", " ").alias("command"),
        "status",
        _shown(F.col("progress")).alias("progress"),
        "priority",
        _shown(F.col("epochs_total").cast("string")).alias("epochs"),
        _shown(F.date_format("deadline", short_time)).alias("deadline"),
        _shown(F.col("assigned_node")).alias("node"),
        _shown(format_gpu_config("assigned_gpu_config")).alias("gpu_config"),
        F.date_format("created_at", short_time).alias("created"),
        _shown(F.col("exit_code").cast("string")).alias("exit"),
    )


def status_counts(jobs: DataFrame, newest: int | None = None) -> DataFrame:
    """A-01. One row of totals, over all jobs or the ``newest`` ones; completed means succeeded
    or failed."""
    if newest is not None:
        jobs = jobs.orderBy(F.desc("created_at"), "id").limit(newest)

    def count(*statuses: str) -> Column:
        return F.count_if(F.col("status").isin(*statuses))

    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        count(C.QUEUED).alias("queued"),
        count(C.PROFILING).alias("profiling"),
        count(C.RUNNING).alias("running"),
        count(C.SUCCEEDED, C.FAILED).alias("completed"),
    )


def representative_jobs(jobs: DataFrame) -> DataFrame:
    """W-02. One job per type: best status, then newest. A minimum per group, combined before
    the shuffle, so a type that owns most jobs costs no more than a rare one."""
    ranked = jobs.select("job_id", "id", "status", "created_at", status_rank().alias("rank"))
    # The newest first among equals: order by time since, counted from a fixed point.
    ranked = ranked.withColumn("_age", F.lit(0).cast("bigint") - F.unix_micros(F.col("created_at").cast("timestamp")))
    best = ranked.groupBy("job_id").agg(
        F.min(F.struct("rank", "_age", "id", "status", "created_at")).alias("best"),
    )
    return best.select("job_id", "best.id", "best.status", "best.created_at", "best.rank")
