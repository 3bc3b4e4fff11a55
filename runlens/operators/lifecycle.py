"""Updates of job rows. Each gives the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import container_name, is_active, is_resumable
from runlens.operators.filters import active_jobs
from runlens.plans.ordered import DEFAULT, HotGroups, join_unique, previous, running_sum, with_ordered


def _by_value(rows: DataFrame, columns: list[str]) -> list[Column]:
    """An order of rows by all of these columns; maps, which have none, by their text."""
    kinds = dict(rows.dtypes)
    return [F.to_json(c) if kinds[c].startswith("map") else F.col(c) for c in columns]


def patch_jobs(jobs: DataFrame, changes: DataFrame, now: Column, newest: list[Column] | None = None) -> DataFrame:
    """K-04. Set the columns of ``changes`` (NULLs too) and ``updated_at`` on the jobs it names.

    Of several changes of a job the greatest under ``newest`` is applied, or the one with the greatest
    values where no order is given. Every job keeps its one row.
    """
    columns = [c for c in changes.columns if c in jobs.columns and c not in ("id", "updated_at")]
    values = F.struct(*[F.col(c) for c in columns])
    order = F.struct(*(newest or _by_value(changes, columns)))
    latest = changes.groupBy("id").agg(F.max_by(values, order).alias("_new"))
    hit = F.col("_new").isNotNull()

    def updated(name: str) -> Column:
        if name == "updated_at":
            return F.when(hit, now).otherwise(F.col(name)).alias(name)
        if name in columns:
            return F.when(hit, F.col("_new")[name]).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return jobs.join(latest, "id", "left").select(*[updated(c) for c in jobs.columns])


def delete_jobs(
    jobs: DataFrame, claims: DataFrame, ids: DataFrame, claims_by: str = "instance_id"
) -> tuple[DataFrame, DataFrame]:
    """K-05. Jobs and claims without the jobs in ``ids``; ``claims_by`` names the claim column
    that holds the job's id."""
    gone = ids.select("id").distinct()
    return jobs.join(gone, "id", "left_anti"), claims.join(gone, claims[claims_by] == gone["id"], "left_anti")


def clear(table: DataFrame) -> DataFrame:
    """K-06. The same table without rows."""
    return table.where(F.lit(False))


def apply_commands(
    jobs: DataFrame, commands: DataFrame, hot: HotGroups = DEFAULT
) -> DataFrame:
    """K-07. Outcome of each command (id, seq, cmd), where cmd is ``stop`` or ``resume``.

    Adds ``status_before``, ``status_after``, ``outcome`` and ``code``. The state before a command
    needs no fold over the earlier ones. It follows from the job's first state, the previous
    command, and whether the command that ends that first state has come yet: a stop does for
    a running job, a resume for a failed one. A job sent very many commands is handled in chunks.
    Any other command is refused (400) whatever the state, which it does not change or read.
    """
    known_commands = F.coalesce(F.col("cmd").isin("stop", "resume"), F.lit(False))
    refused = commands.where(~known_commands).select(
        "id",
        "seq",
        "cmd",
        F.lit(None).cast("string").alias("status_before"),
        F.lit(None).cast("string").alias("status_after"),
        F.lit("unknown_command").alias("outcome"),
        F.lit(400).alias("code"),
    )
    commands = commands.where(known_commands)
    counted = commands.select(
        "id",
        "seq",
        "cmd",
        F.when(F.col("cmd") == "stop", 1).otherwise(0).alias("_is_stop"),
        F.when(F.col("cmd") == "resume", 1).otherwise(0).alias("_is_resume"),
    )
    ordered = with_ordered(
        counted,
        ["id"],
        ["seq"],
        {"_prev": previous("cmd"), "_stops": running_sum("_is_stop"), "_resumes": running_sum("_is_resume")},
        hot,
    )
    known = join_unique(ordered, jobs.select("id", F.col("status").alias("_first")), ["id"], hot, counted=commands)
    first, prev = F.col("_first"), F.col("_prev")
    never_stopped = F.col("_stops") - F.col("_is_stop") == 0
    never_resumed = F.col("_resumes") - F.col("_is_resume") == 0
    movable = first.isin(*C.STOPPABLE, *C.RESUMABLE)
    before = (
        F.when(first.isNull() | ~movable | prev.isNull(), first)
        .when((prev == "stop") & (first == C.FAILED) & never_resumed, first)
        .when(prev == "stop", F.lit(C.PREEMPTED))
        .when(is_active(first) & never_stopped, first)
        .otherwise(F.lit(C.QUEUED))
    )
    state, cmd = F.col("status_before"), F.col("cmd")
    stop, resume = cmd == "stop", cmd == "resume"
    outcome = (
        F.when(state.isNull(), "not_found")
        .when(stop & (state == C.QUEUED), "stopped")
        .when(stop & is_active(state), "stop_requested")
        .when(resume & is_resumable(state), "resume_requested")
        .otherwise("conflict")
    )
    code = F.when(F.col("outcome") == "not_found", 404).when(F.col("outcome") == "conflict", 409).otherwise(202)
    after = (
        F.when(F.col("code") != 202, state).when(stop, F.lit(C.PREEMPTED)).otherwise(F.lit(C.QUEUED))
    )
    return (
        known.withColumn("status_before", before)
        .withColumn("outcome", outcome)
        .withColumn("code", code)
        .withColumn("status_after", after)
        .select("id", "seq", "cmd", "status_before", "status_after", "outcome", "code")
        .union(refused)
    )


def commanded_jobs(jobs: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """K-07. The jobs table after the commands were applied."""
    accepted = outcomes.where(F.col("code") == 202)
    changes = accepted.select("id", "seq", F.col("status_after").alias("status"))
    return patch_jobs(jobs, changes, now, newest=[F.col("seq")])


def resolve_outcomes(
    jobs: DataFrame, exits: DataFrame, now: Column, newest: list[Column] | None = None
) -> DataFrame:
    """K-08. Jobs after their runs (id, exit_code) ended, with ``replan`` on those to plan again.

    Of several exits of a job the greatest under ``newest`` counts, or the one with the highest code, so a
    report that is sent twice changes nothing and a failure is not lost. A stopped job stays stopped. A finished profiling run goes back to the queue without a
    node and keeps its old exit code, which says that no full run has ended yet.
    """
    order = F.struct(*(newest or [F.col("exit_code")]))
    ended = exits.where("exit_code is not null").groupBy("id").agg(F.max_by("exit_code", order).alias("_exit"))
    code, hit = F.col("_exit"), F.col("_exit").isNotNull()
    stopped = F.col("status") == C.PREEMPTED
    profiled = hit & ~stopped & (code == 0) & F.col("is_profiling_run")
    profiled = F.coalesce(profiled, F.lit(False))
    values = {
        "status": F.when(~hit | stopped, F.col("status"))
        .when(code != 0, F.lit(C.FAILED))
        .when(profiled, F.lit(C.QUEUED))
        .otherwise(F.lit(C.SUCCEEDED)),
        "exit_code": F.when(hit & ~profiled, code).otherwise(F.col("exit_code")),
        "is_profiling_run": F.when(profiled, F.lit(False)).otherwise(F.col("is_profiling_run")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }
    for name in ("assigned_node", "assigned_gpu_config", "config_key"):
        values[name] = F.when(~profiled, F.col(name))
    joined = jobs.join(ended, "id", "left")
    columns = [values[c].alias(c) if c in values else F.col(c) for c in jobs.columns]
    return joined.select(*columns, profiled.alias("replan"))


def orphaned_jobs(
    jobs: DataFrame, live: DataFrame, node: str | None = None, prefix: str = C.CONTAINER_PREFIX
) -> DataFrame:
    """J-08. Active jobs (of one node) whose container (``live.name``) is gone; they have failed."""
    running = active_jobs(jobs).where(F.col("assigned_node") == node) if node else jobs.where(is_active())
    expected = running.withColumn("expected_container", container_name(prefix=prefix))
    live = live.select(F.col("name").alias("expected_container")).distinct()
    return expected.join(live, "expected_container", "left_anti").select(
        "id", "expected_container", F.col("status").alias("old_status"), F.lit(C.FAILED).alias("status")
    )
