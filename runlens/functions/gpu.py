"""Functions over GPU configurations (map of GPU type to count)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _entries(config: Column | str) -> Column:
    return F.sort_array(F.map_entries(config))


def config_key(config: Column | str) -> Column:
    """F-01. Canonical text of a configuration. Maps cannot be compared, so every join and
    grouping on a configuration uses this key."""
    return F.to_json(F.map_from_entries(_entries(config)))


def format_gpu_config(config: Column | str) -> Column:
    """F-02. ``2× A40 + 1× L40S``, by type; NULL stays NULL."""
    parts = F.transform(_entries(config), lambda e: F.concat(e["value"].cast("string"), F.lit("× "), e["key"]))
    return F.array_join(parts, " + ")


def config_total(config: Column | str) -> Column:
    """F-06. Number of GPUs in a configuration."""
    return F.aggregate(F.map_values(config), F.lit(0), lambda acc, n: acc + n)
