"""Streaming operators run over the tables as files that arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import fixtures as fx
from runlens.operators import temporal
from runlens.session import new_folder
from runlens.streaming import jobs as job_streams
from runlens.streaming import logs, snapshots
from runlens.streaming.sinks import newest_rows, start, start_to_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def query(function):
    QUERIES[function.__name__] = function
    return function


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, logs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


#: The column whose order a table's files follow.
TIMES = {"events": "ts", "lineitem": "l_shipdate", "customer": "c_custkey"}
FILES = 3


def _stream(spark: SparkSession, sf: str, name: str, repeated: bool = False, files: int = FILES, closing: bool = False) -> DataFrame:
    """The table as files by time, one micro-batch each. With ``repeated``, the rows of every seventh second or key come
    once more in a last file: late, and in no order. With ``closing``, a last file holds one row of NULLs, ten years after the others."""
    folder = new_folder(spark, f"arrivals-{name}")
    rows, time = fx.table(spark, sf, name), TIMES[name]
    rows.repartitionByRange(files, time).write.parquet(folder)
    if repeated:
        again = rows.where(F.pmod(F.xxhash64(time), F.lit(7)) == 0).orderBy(F.rand(3)).coalesce(1)
        again.write.mode("append").parquet(folder)
    if closing:
        last = (F.max(time) + F.expr("INTERVAL '10' YEAR")).alias(time)
        end = rows.agg(last).select(*[F.col(c) if c == time else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        end.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(fx.TABLES[name]).option("maxFilesPerTrigger", 1).parquet(folder)


def _lines(spark: SparkSession, sf: str, repeated: bool = False, files: int = FILES) -> DataFrame:
    """Log lines as they arrive; their epoch comes from the event's own number."""
    return _stream(spark, sf, "events", repeated, files).selectExpr(
        "concat('job-', user_id) AS run_id",
        "event_id AS line_no",
        "CAST(ts AS TIMESTAMP) AS ts",
        "CASE WHEN event_type = 'error' THEN 'Checkpoint saved'"
        " ELSE concat('Epoch ', 1 + event_id % 500, '/500 - Loss: ', CAST(value AS DECIMAL(12,2))) END AS line",
    )


def _folders(spark: SparkSession, name: str) -> tuple[str, str]:
    base = new_folder(spark, name)
    return f"{base}/rows", f"{base}/checkpoint"


@query
def stream_epoch_lines(spark, sf):
    """T-01."""
    rows, checkpoint = _folders(spark, "epoch-lines")
    start_to_folder(logs.epoch_stream(_lines(spark, sf)), rows, checkpoint).awaitTermination()
    return spark.read.parquet(rows).select("run_id", "line_no", "epoch", "total")


@query
def stream_latest_progress(spark, sf):
    """T-02."""
    rows, checkpoint = _folders(spark, "progress")
    start_to_folder(logs.latest_progress_stream(_lines(spark, sf, repeated=True), "30 days"), rows, checkpoint, "update").awaitTermination()
    latest = newest_rows(spark.read.parquet(rows), ["run_id"], [F.col("ts"), F.col("line_no")])
    return latest.select("run_id", "progress")


@query
def stream_run_duration(spark, sf):
    """T-03, T-04. Runs of customers that end, and runs that only log and go over the limit."""
    rows, checkpoint = _folders(spark, "durations")
    ends = _stream(spark, sf, "customer", files=1).where("c_custkey % 5 <> 0").selectExpr(
        "concat('job-', c_custkey) AS run_id",
        "TIMESTAMP '2024-01-01 00:00:00' AS started_at",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 1 + c_custkey % 20) AS ended_at",
    )
    events = logs.run_events(logs.epoch_stream(_lines(spark, sf, files=1)), ends)
    with _rocksdb(spark):
        start_to_folder(logs.run_duration_stream(events), rows, checkpoint).awaitTermination()
    durations = spark.read.parquet(rows).select("run_id", "outcome", "n_marks", "duration_seconds")
    return durations.withColumn("duration_seconds", F.round("duration_seconds", 2))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Status changes of jobs, several per job, from events."""
    return _stream(spark, sf, "events", repeated=True).selectExpr(
        "concat('job-', user_id) AS id",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'click' THEN 'RUNNING'"
        " ELSE 'QUEUED' END AS status",
        "ts",
        "event_id",
    )


@query
def stream_status_counts(spark, sf):
    """T-06, T-07. The changes are folded into a snapshot after every second batch."""
    rows, checkpoint = _folders(spark, "changes")
    newest = [F.col("ts"), F.col("event_id")]
    start(_changes(spark, sf), snapshots.latest_handler(rows, ["id"], newest, every=2), checkpoint).awaitTermination()
    return job_streams.live_status_counts(fx.jobs(spark, sf), snapshots.latest(spark, rows, ["id"], newest), newest, fx.now())


@query
def stream_dispatches(spark, sf):
    """T-08. Lineitems of an order are repeated dispatches of it, some first ones come late, and some come twice."""
    rows, checkpoint = _folders(spark, "dispatches")
    dispatches = _stream(spark, sf, "lineitem", repeated=True).selectExpr(
        "concat('job-', l_orderkey) AS id", "l_linenumber % 2 AS attempt", "CAST(l_shipdate AS TIMESTAMP) AS ts"
    )
    start(dispatches, job_streams.dispatch_handler(rows), checkpoint).awaitTermination()
    return spark.read.parquet(rows).select("id", "attempt")


@query
def stream_replan(spark, sf):
    """T-05. Measured claims arrive and the waiting jobs are planned again."""
    rows, checkpoint = _folders(spark, "replan")
    results = _stream(spark, sf, "lineitem", files=1).where("l_returnflag = 'N'")
    results = fx.with_config(fx.claim_columns(results)).withColumn("duration_seconds", F.col("_quantity") * 7)

    def tables(session: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        return fx.jobs(session, sf), fx.claims(session, sf), fx.nodes(session, sf)

    order = ["_quantity", *fx.CLAIM_ORDER]
    handler = job_streams.replan_handler(tables, rows, order, now=fx.now())
    start(results, handler, checkpoint).awaitTermination()
    return spark.read.parquet(f"{rows}/plan").drop("batch")


@query
def restart_recovery(spark, sf):
    """T-09."""
    live = fx.table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr(
        "concat('run-', substr(concat('job-', o_orderkey), 1, 8)) AS name"
    )
    return job_streams.recovery(fx.jobs(spark, sf), live)


@query
def stream_log_sessions(spark, sf):
    """Session windows on a stream: a last file, years later, lets the watermark pass the end of every session."""
    rows, checkpoint = _folders(spark, "sessions")
    lines = _stream(spark, sf, "events", closing=True).selectExpr("concat('job-', user_id) AS run_id", "CAST(ts AS TIMESTAMP) AS ts")
    found = temporal.sessions(lines.withWatermark("ts", "1 hour"), ["run_id"], "ts", fx.SILENCE)
    start_to_folder(found, rows, checkpoint).awaitTermination()
    kept = spark.read.parquet(rows).where("run_id IS NOT NULL")
    return kept.select("run_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("last_line").cast("timestamp_ntz").alias("last_line"), "n_lines")
