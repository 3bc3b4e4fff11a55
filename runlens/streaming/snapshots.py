"""The latest row per key of a stream of changes, with a look that does not read all history.

Changes are kept one folder per micro-batch. Every so many batches they are folded with the snapshot before into a new
one: one row per key, in buckets by hash. A look reads the newest snapshot and the few batches after it. Batches that the
snapshot *before* the newest covers are dropped, and snapshots older than that one, so a batch that runs again after a failure
still finds all it folds and writes the same.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.streaming.sinks import BatchHandler, batch_folder, newest_rows, write_batch

#: Fold after so many batches.
EVERY = 16
#: Rows of a snapshot are dealt by key into so many parts when it is written.
BUCKETS = 64


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The n of all complete folders ``name=n`` below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    found = (re.fullmatch(rf"{name}=(\d+)", s.getPath().getName()) for s in files.listStatus(path))
    numbers = [int(m[1]) for m in found if m]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(n for n in numbers if files.exists(done(f"{folder}/{name}={n}/_SUCCESS")))


def _drop(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _read(spark: SparkSession, folders: list[str]) -> DataFrame | None:
    return spark.read.parquet(*folders) if folders else None


def _upto(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame | None:
    """The newest snapshot before ``batch`` (of all, if None) and the changes after it up to ``batch``."""
    through = [n for n in _numbers(spark, f"{folder}/snapshots", "through") if batch is None or n < batch]
    since = through[-1] if through else -1
    batches = [n for n in _numbers(spark, f"{folder}/changes", "batch") if n > since and (batch is None or n <= batch)]
    folders = [f"{folder}/snapshots/through={n}" for n in through[-1:]]
    return _read(spark, folders + [batch_folder(f"{folder}/changes", n) for n in batches])


def latest_handler(folder: str, keys: Sequence[str], newest: Sequence[Column], every: int = EVERY) -> BatchHandler:
    """T-07. Keep the newest change per key; fold changes into a snapshot after every ``every`` batches."""
    keys, newest = list(keys), list(newest)

    def handle(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        write_batch(newest_rows(changes, keys, newest), f"{folder}/changes", batch)
        if (batch + 1) % every:
            return
        latest = newest_rows(_upto(spark, folder, batch), keys, newest).repartition(BUCKETS, *keys)
        latest.write.mode("overwrite").parquet(f"{folder}/snapshots/through={batch}")
        older = [n for n in _numbers(spark, f"{folder}/snapshots", "through") if n < batch]
        for n in [n for n in _numbers(spark, f"{folder}/changes", "batch") if older and n <= older[-1]]:
            _drop(spark, batch_folder(f"{folder}/changes", n))
        for n in older[:-1]:
            _drop(spark, f"{folder}/snapshots/through={n}")

    return handle


def latest(spark: SparkSession, folder: str, keys: Sequence[str], newest: Sequence[Column]) -> DataFrame | None:
    """T-06. The newest change of every key; None before the first batch."""
    found = _upto(spark, folder)
    return None if found is None else newest_rows(found, list(keys), list(newest))


def rows_to_read(spark: SparkSession, folder: str) -> tuple[int, int]:
    """How many snapshots and how many batches a look reads."""
    through = _numbers(spark, f"{folder}/snapshots", "through")
    return len(through[-1:]), len([n for n in _numbers(spark, f"{folder}/changes", "batch") if n > (through or [-1])[-1]])
