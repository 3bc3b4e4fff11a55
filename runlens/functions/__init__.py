"""Column-to-column functions, all built-in expressions."""

from runlens.functions.gpu import config_key, config_total, format_gpu_config
from runlens.functions.jobs import (
    container_name,
    is_active,
    is_first_run,
    is_resumable,
    is_runnable,
    is_stoppable,
    role,
    run_env,
    status_rank,
)
from runlens.functions.text import (
    attempt_start,
    epoch_line,
    format_duration,
    has_progress,
    is_epoch_line,
    is_uuid,
    line_time,
    mask_credentials,
    progress,
    short_id,
)

__all__ = [
    "attempt_start",
    "config_key",
    "config_total",
    "container_name",
    "epoch_line",
    "format_duration",
    "format_gpu_config",
    "has_progress",
    "is_active",
    "is_epoch_line",
    "is_first_run",
    "is_resumable",
    "is_runnable",
    "is_stoppable",
    "is_uuid",
    "line_time",
    "mask_credentials",
    "progress",
    "role",
    "run_env",
    "short_id",
    "status_rank",
]
