"""Functions over job and node rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions.text import _col, short_id


def is_stoppable(status: Column | str = "status") -> Column:
    """S-03."""
    return _col(status).isin(*C.STOPPABLE)


def is_resumable(status: Column | str = "status") -> Column:
    """S-03."""
    return _col(status).isin(*C.RESUMABLE)


def is_runnable(status: Column | str = "status") -> Column:
    """S-03."""
    return _col(status).isin(*C.RUNNABLE)


def is_active(status: Column | str = "status") -> Column:
    """The job holds GPUs."""
    return _col(status).isin(*C.ACTIVE)


def container_name(
    job: Column | str = "id", stored: Column | str | None = "container_name", prefix: str = C.CONTAINER_PREFIX
) -> Column:
    """F-08. The stored name, else the prefix and the short id."""
    derived = F.concat(F.lit(prefix), short_id(job))
    return derived if stored is None else F.coalesce(F.nullif(_col(stored), F.lit("")), derived)


def run_env(
    is_profiling_run: Column | str = "is_profiling_run",
    profiling_epochs: Column | str = "profiling_epochs_no",
    epochs_total: Column | str = "epochs_total",
    batch_size: Column | str = "batch_size",
    worker: bool = False,
) -> Column:
    """F-09. Environment of a run; settings that are unset or zero are left out."""

    def positive(value: Column | str) -> Column:
        return F.when(_col(value) != 0, _col(value))

    epochs = F.when(
        F.coalesce(_col(is_profiling_run), F.lit(False)),
        F.coalesce(positive(profiling_epochs), F.lit(C.DEFAULT_PROFILING_EPOCHS)),
    ).otherwise(positive(epochs_total))
    pairs = {"EPOCHS_TOTAL": epochs.cast("string"), "BATCH_SIZE": positive(batch_size).cast("string")}
    if worker:
        pairs = {**{k: F.lit(v) for k, v in C.WORKER_THREAD_ENV.items()}, **pairs}
    entries = [item for k, v in pairs.items() for item in (F.lit(k), v)]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


def status_rank(status: Column | str = "status") -> Column:
    """F-12. Listing rank of a status; unknown ones come last."""
    s = _col(status)
    first, *rest = C.STATUS_RANK.items()
    chain = reduce(lambda acc, kv: acc.when(s == kv[0], kv[1]), rest, F.when(s == first[0], first[1]))
    return chain.otherwise(C.OTHER_STATUS_RANK)


def role(is_for_profiling: Column | str = "is_for_profiling") -> Column:
    """F-13."""
    return F.when(_col(is_for_profiling), "Profiling").otherwise("Compute")


def is_first_run(exit_code: Column | str = "exit_code") -> Column:
    """F-14. The job has never finished a run."""
    return _col(exit_code).isNull()
