"""Row filters and projections over jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import is_active


def get_job(jobs: DataFrame, job: str) -> DataFrame:
    """S-04. The row of one job, or nothing."""
    return jobs.where(F.col("id") == job)


def waiting(jobs: DataFrame) -> DataFrame:
    """Queued jobs without a node, in no order."""
    return jobs.where((F.col("status") == C.QUEUED) & F.col("assigned_node").isNull())


def waiting_jobs(jobs: DataFrame) -> DataFrame:
    """S-05. Queued jobs without a node, oldest first."""
    return oldest_first(waiting(jobs))


def active_jobs(jobs: DataFrame) -> DataFrame:
    """S-06. Jobs that hold a node."""
    return jobs.where(is_active() & F.col("assigned_node").isNotNull())


def missed_queued(jobs: DataFrame, node: str | None = None) -> DataFrame:
    """S-07. Queued jobs (of one node), oldest first."""
    queued = jobs.where(F.col("status") == C.QUEUED)
    if node is not None:
        queued = queued.where(F.col("assigned_node") == node)
    return oldest_first(queued)


def search_status(jobs: DataFrame, text: str) -> DataFrame:
    """S-08. Jobs whose status contains the text, in any case."""
    return jobs.where(F.lower("status").contains(text.lower()))


def select_columns(jobs: DataFrame, *columns: str) -> DataFrame:
    """S-09. Only the named columns; all of them by default."""
    return jobs.select(*columns) if columns else jobs


def oldest_first(jobs: DataFrame) -> DataFrame:
    """O-02."""
    return jobs.orderBy("created_at", "id")
