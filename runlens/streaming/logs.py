"""Streams of log lines (run_id, line_no, ts, line)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runlens import constants as C
from runlens.operators.runs import ORDER, epoch_marks, run_duration
from runlens.streaming.arrivals import first_arrivals_handler
from runlens.streaming.sinks import BatchHandler

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def epoch_stream(lines: DataFrame) -> DataFrame:
    """T-01. The lines that report progress. Stateless."""
    return epoch_marks(lines)


def distinct_lines_handler(folder: str, key: str = "line_no") -> BatchHandler:
    """Store each line once, known by its id, however late it first comes. Repeated epoch numbers are not duplicates.

    The folder can be read as the stream of the operators below.
    """
    return first_arrivals_handler(folder, ["run_id", key])


def latest_progress_stream(lines: DataFrame, idle: str | None = None) -> DataFrame:
    """T-02. Last progress per run, for update mode.

    The last line by time wins, so a late line does not move progress back. With ``idle`` (``30 days``), the state of a run is
    kept per stretch of that length and dropped once the newest line of all is so much later; readers take the newest row of a
    run as before, so no progress is lost. Lines that come later than that are left out.
    """
    marks = epoch_marks(lines)
    keys = ["run_id"]
    if idle:
        marks = marks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
        keys.append(F.window("ts", idle))
    last = marks.groupBy(*keys).agg(F.max(F.struct(*ORDER, "epoch", "total")).alias("last"))
    text = F.concat(F.col("last.epoch").cast("string"), F.lit("/"), F.col("last.total").cast("string"))
    return last.select("run_id", text.alias("progress"), "last.ts", "last.line_no")


# One partial summary of a run's lines. Times are microseconds; ``first_us`` and ``second_us`` are
# the two earliest epoch lines, the ``last_`` columns the latest one.
SUMMARY = (
    "run_id string, ts timestamp, n_marks bigint, first_us bigint, second_us bigint, last_us bigint, "
    "last_line_no bigint, last_epoch bigint, started_us bigint, ended_us bigint"
)
STATE = SUMMARY.replace("run_id string, ts timestamp, ", "") + ", closed boolean"
RESULT = (
    "run_id string, outcome string, n_marks bigint, second_us bigint, last_us bigint, last_epoch bigint, "
    "started_us bigint, ended_us bigint"
)
FIELDS = [part.split()[0] for part in STATE.split(", ")]


def run_events(marks: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Epoch lines, and ends of runs (run_id, started_at, ended_at), as one stream of summaries."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    none = F.lit(None).cast("bigint")
    events = marks.select(
        "run_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.lit(1).cast("bigint").alias("n_marks"),
        us.alias("first_us"),
        none.alias("second_us"),
        us.alias("last_us"),
        F.col("line_no").alias("last_line_no"),
        F.col("epoch").alias("last_epoch"),
        none.alias("started_us"),
        none.alias("ended_us"),
    )
    if ends is None:
        return events
    started, ended = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "ended_at"))
    closing = ends.select(
        "run_id",
        F.col("ended_at").cast("timestamp").alias("ts"),
        F.lit(0).cast("bigint").alias("n_marks"),
        *[none.alias(c) for c in ("first_us", "second_us", "last_us", "last_line_no", "last_epoch")],
        started.alias("started_us"),
        ended.alias("ended_us"),
    )
    return events.unionByName(closing)


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    """One summary per run of the given ones."""
    early = rows[["run_id", "first_us"]].rename(columns={"first_us": "us"})
    second = rows[["run_id", "second_us"]].rename(columns={"second_us": "us"})
    times = pd.concat([early, second]).dropna().sort_values(["run_id", "us"])
    place = times.groupby("run_id").cumcount()
    last = rows.dropna(subset=["last_us"]).sort_values(["last_us", "last_line_no"]).groupby("run_id").tail(1)
    grouped = rows.groupby("run_id")
    out = grouped.agg({"ts": "max", "n_marks": "sum", "started_us": "min", "ended_us": "max"})
    out["first_us"] = times[place == 0].set_index("run_id")["us"]
    out["second_us"] = times[place == 1].set_index("run_id")["us"]
    for column in ("last_us", "last_line_no", "last_epoch"):
        out[column] = last.set_index("run_id")[column]
    return out.reset_index()


def _ordered(*times: int | None) -> list[int]:
    return sorted(t for t in times if t is not None)


def _merge(one: dict[str, Any], other: dict[str, Any]) -> dict[str, Any]:
    """The summary of two summaries of a run."""
    early = _ordered(one["first_us"], one["second_us"], other["first_us"], other["second_us"])
    place = lambda s: (s["last_us"] is not None, s["last_us"] or 0, s["last_line_no"] or 0)
    last = max(one, other, key=place)
    return {
        "n_marks": (one["n_marks"] or 0) + (other["n_marks"] or 0),
        "first_us": early[0] if early else None,
        "second_us": early[1] if len(early) > 1 else None,
        **{f: last[f] for f in ("last_us", "last_line_no", "last_epoch")},
        "started_us": min(_ordered(one["started_us"], other["started_us"]), default=None),
        "ended_us": max(_ordered(one["ended_us"], other["ended_us"]), default=None),
    }


def _typed(rows: pd.DataFrame) -> pd.DataFrame:
    numbers = [c for c in rows.columns if c not in ("run_id", "ts")]
    return rows.astype(dict.fromkeys(numbers, "Int64"))


def _combine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Summaries per run and Arrow batch, so that a run that writes most of the log reaches the
    shuffle as a few rows."""
    columns = [part.split()[0] for part in SUMMARY.split(", ")]
    for rows in batches:
        if len(rows):
            yield _typed(_combine(_typed(rows)))[columns]


class RunDurations(StatefulProcessor):
    """State per run: the summary of its lines so far, whatever order they came in."""

    def __init__(self, limit_seconds: int = C.JOB_TIMEOUT_SECONDS) -> None:
        self.limit_us = limit_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)

    def _read(self) -> dict[str, Any] | None:
        stored = self.run.get()
        return dict(zip(FIELDS, stored, strict=True)) if stored else None

    def _result(self, key: tuple, state: dict[str, Any], outcome: str) -> pd.DataFrame:
        names = ["n_marks", "second_us", "last_us", "last_epoch", "started_us", "ended_us"]
        values = {name: pd.array([state[name]], dtype="Int64") for name in names}
        return pd.DataFrame({"run_id": [key[0]], "outcome": [outcome], **values})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self._read()
        if before and before["closed"]:
            return
        state = before or dict.fromkeys(FIELDS)
        for part in rows:
            for values in part[FIELDS[:-1]].itertuples(index=False, name=None):
                state = _merge(state, dict(zip(FIELDS, (None if pd.isna(v) else int(v) for v in values), strict=False)))
        state["closed"] = state["ended_us"] is not None
        self.run.update(tuple(state[f] for f in FIELDS))
        # A closed run is kept until the limit: a late line must not open it again.
        begun = _ordered(state["started_us"], state["first_us"])
        wake = (state["ended_us"] if state["closed"] else begun[0]) + self.limit_us
        if before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        self.handle.registerTimer(wake // 1000)
        if state["closed"]:
            yield self._result(key, state, "ended")

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state = self._read()
        self.run.clear()
        if state and not state["closed"]:
            yield self._result(key, state, "timeout")

    def close(self) -> None:
        pass


def run_duration_stream(
    events: DataFrame, delay: str = "1 hour", limit_seconds: int = C.JOB_TIMEOUT_SECONDS
) -> DataFrame:
    """T-03, T-04. One row per run when it ends, or when the limit passes without an end.

    ``events`` comes from ``run_events`` over streams without a watermark. The session needs the
    RocksDB state store.
    """
    combined = events.mapInPandas(_combine_batches, SUMMARY).withWatermark("ts", delay)
    closed = combined.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=RunDurations(limit_seconds),
        outputStructType=RESULT,
        outputMode="Append",
        timeMode="EventTime",
    )
    enough = F.col("n_marks") >= 3
    steady = (F.col("last_us") - F.col("second_us")) / 1e6 / F.when(enough, F.col("n_marks") - 2) * F.col("last_epoch")
    wall = (F.col("ended_us") - F.col("started_us")) / 1e6
    return closed.select("run_id", "outcome", "n_marks", F.coalesce(steady, wall).alias("duration_seconds"))


def corrected_durations(closed: DataFrame, marks: DataFrame, ends: DataFrame) -> DataFrame:
    """T-03. The results of ``run_duration_stream`` with the runs computed again (A-09) of which lines came behind the watermark.

    ``marks`` are all epoch lines stored so far, ``ends`` the runs with their start and end. Only runs whose number of
    lines differs are read again.
    """
    counted = marks.groupBy("run_id").agg(F.count(F.lit(1)).alias("_all"))
    late = closed.join(counted, "run_id").where(F.col("_all") != F.col("n_marks")).select("run_id", "outcome")
    runs = late.join(ends, "run_id", "left").select("run_id", "started_at", "ended_at")
    again = run_duration(marks.join(late, "run_id", "left_semi"), runs).join(late, "run_id")
    kept = closed.join(late, "run_id", "left_anti")
    return kept.unionByName(again.select(*[F.col(c).cast(t).alias(c) for c, t in closed.dtypes]))
