"""Readers and writers."""

from runlens.sources.log_table import (
    append_log_table,
    compact_log_table,
    log_manifest,
    log_table_sizes,
    read_log_table,
    refused_in_table,
)
from runlens.sources.readers import (
    log_sizes,
    number_lines,
    read_claims,
    read_gpu_costs,
    read_jobs,
    read_node_lines,
    read_nodes,
    read_run_logs,
    read_submissions,
    refused_logs,
    with_config_key,
    with_job_defaults,
)
from runlens.sources.writers import append_rows, write_run_logs, write_version

__all__ = [
    "append_log_table",
    "append_rows",
    "compact_log_table",
    "log_manifest",
    "log_sizes",
    "log_table_sizes",
    "number_lines",
    "read_claims",
    "read_gpu_costs",
    "read_jobs",
    "read_log_table",
    "read_node_lines",
    "read_nodes",
    "read_run_logs",
    "read_submissions",
    "refused_in_table",
    "refused_logs",
    "with_config_key",
    "with_job_defaults",
    "write_run_logs",
    "write_version",
]
