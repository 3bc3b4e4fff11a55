"""Streams of job changes, completions and dispatches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.claims import Order, complete_claims, merge_claims
from runlens.operators.filters import missed_queued
from runlens.operators.lifecycle import orphaned_jobs, patch_jobs
from runlens.operators.listing import status_counts
from runlens.plans.placement import plan_round, planned_claims
from runlens.streaming.arrivals import first_arrivals_handler, stored
from runlens.streaming.sinks import BatchHandler, batch_folder, newest_rows, write_batch

Tables = Callable[[SparkSession], tuple[DataFrame, DataFrame, DataFrame]]


def upsert_handler(folder: str, newest: list[Column]) -> BatchHandler:
    """T-07. Keep the newest change per job of each micro-batch.

    Only the changed jobs are written. Readers put the changes over the table with
    ``current_jobs``, and ``write_version`` folds them in when they have grown.
    """

    def handle(changes: DataFrame, batch: int) -> None:
        write_batch(newest_rows(changes, ["id"], newest), folder, batch)

    return handle


def current_jobs(jobs: DataFrame, changes: DataFrame, newest: list[Column], now: Column) -> DataFrame:
    """T-07. The jobs table with the stored changes applied."""
    return patch_jobs(jobs, changes, now, newest)


def live_status_counts(jobs: DataFrame, changes: DataFrame, newest: list[Column], now: Column) -> DataFrame:
    """T-06. Counts over the latest state of each job; a job that changed twice counts once."""
    return status_counts(current_jobs(jobs, changes, newest, now))


def dispatch_handler(folder: str) -> BatchHandler:
    """T-08. Store the first dispatch of each attempt (id, attempt, ts), however late it comes; repeats are dropped."""
    return first_arrivals_handler(folder, ["id", "attempt"])


def replan_handler(
    tables: Tables, folder: str, order: Order, limit: int = 1, now: Column | None = None
) -> BatchHandler:
    """T-05. After each batch of measured claims, complete them and plan the waiting jobs again.

    ``tables`` loads (jobs, claims, nodes) as they are now. The plan of a batch goes to
    ``folder/plan/batch=n``, and the claims after it, those the plan makes included, to
    ``folder/claims/batch=n``. A batch starts from the claims of the one before and from new ones
    in ``tables``, so running it again after a failure gives the same. Each step is written and
    read back, so the next one neither repeats it nor sees other data.
    """
    made_at = F.current_timestamp() if now is None else now

    def handle(results: DataFrame, batch: int) -> None:
        spark = results.sparkSession
        jobs, claims, nodes = tables(spark)
        before = stored(spark, batch_folder(f"{folder}/claims", batch - 1))
        if before is not None:
            claims = merge_claims(before, claims, ["created_at", "instance_id"])
        write_batch(complete_claims(claims, results, order), f"{folder}/completed", batch)
        completed = spark.read.parquet(batch_folder(f"{folder}/completed", batch))
        write_batch(plan_round(jobs, completed, nodes, limit), f"{folder}/plan", batch)
        plan = spark.read.parquet(batch_folder(f"{folder}/plan", batch))
        made = planned_claims(plan, made_at)
        write_batch(merge_claims(completed, made, ["instance_id"]), f"{folder}/claims", batch)

    return handle


def recovery(jobs: DataFrame, live: DataFrame, node: str | None = None) -> DataFrame:
    """T-09. What a restart has to do: fail the active jobs whose container is gone, and
    dispatch the queued ones again, oldest first by ``created_at``."""
    failed = orphaned_jobs(jobs, live, node).select("id").withColumn("action", F.lit("fail"))
    queued = missed_queued(jobs, node).select("id").withColumn("action", F.lit("dispatch"))
    return failed.unionByName(queued)


def recovering(handler: BatchHandler, recover: Callable[[SparkSession, int], None]) -> BatchHandler:
    """T-09. Run ``recover`` before the first micro-batch after a start; the stream itself goes
    on from its checkpoint."""
    pending = [True]

    def handle(rows: DataFrame, batch: int) -> None:
        if pending:
            recover(rows.sparkSession, batch)
            pending.clear()
        handler(rows, batch)

    return handle
