"""Job, node, claim and log tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import config_key
from runlens.plans.ordered import first_by, row_number, with_ordered

NOW = "1997-01-01 00:00:00"

# Price list, EUR per hour by GPU type and count.
GPU_COSTS = [
    ("A40", 1, 0.15),
    ("A40", 2, 0.28),
    ("A40", 4, 0.54),
    ("L40S", 1, 0.18),
    ("L40S", 2, 0.34),
    ("L40S", 4, 0.65),
    ("Blackwell", 1, 0.45),
    ("Blackwell", 2, 0.85),
    ("Blackwell", 4, 1.60),
]


# Schemas of the given tables. Declared, so that building a query reads no file.
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _config(a40: str = "a40", l40s: str = "l40s") -> Column:
    both = F.create_map(F.lit("A40"), F.col(a40), F.lit("L40S"), F.col(l40s))
    return F.map_filter(both, lambda _, n: n > 0)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """fx_jobs, one job per order."""
    rows = table(spark, folder, "orders").selectExpr(
        "concat('job-', o_orderkey) AS id",
        "concat('type-', o_custkey % 40) AS job_id",
        "CASE WHEN o_orderkey % 17 = 0 THEN '../evil' ELSE concat('train-img:v', o_custkey % 7) END AS image",
        """CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'SUCCEEDED' WHEN o_orderstatus = 'F' THEN 'FAILED'
                WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'QUEUED' WHEN o_orderstatus = 'O' THEN 'PREEMPTED'
                WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'PROFILING' END AS status""",
        "o_orderdate AS created_at",
        """CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL '2' DAY
                ELSE o_orderdate - INTERVAL '1' DAY END AS deadline""",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS priority",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 20 AS INT) END AS epochs_total",
        "CASE WHEN o_orderstatus = 'P' AND o_orderkey % 25 = 0 THEN concat('node-', o_custkey % 100) END AS assigned_node",
        "CAST(1 + o_custkey % 2 AS INT) AS a40",
        "CAST(o_orderkey % 2 AS INT) AS l40s",
        "CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('train', o_orderkey % 3, '.py') END AS script_path",
        "CASE WHEN o_orderkey % 6 = 0 THEN CAST(0 AS INT) WHEN o_orderkey % 6 = 1 THEN CAST(NULL AS INT)"
        " ELSE CAST(16 * (o_orderkey % 6) AS INT) END AS batch_size",
        "CASE WHEN o_orderkey % 7 = 0 THEN CAST(NULL AS INT) ELSE CAST(1 + o_orderkey % 5 AS INT) END AS profiling_epochs_no",
        "CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 3 AS INT) END AS exit_code",
    )
    return rows.select(
        "*",
        (F.col("status") == "PROFILING").alias("is_profiling_run"),
        F.lit(None).cast("string").alias("container_name"),
        F.lit(None).cast("string").alias("progress"),
        F.array(F.lit("python3"), F.lit("main.py")).alias("command"),
        F.col("created_at").alias("updated_at"),
        _config().alias("assigned_gpu_config"),
        config_key(_config()).alias("config_key"),
    ).drop("a40", "l40s")


def submissions(spark: SparkSession, folder: str) -> DataFrame:
    """The same jobs as they were submitted."""
    return jobs(spark, folder).select(
        "id", "job_id", "image", "script_path", "command", "priority", "deadline", "batch_size", "epochs_total",
        "profiling_epochs_no",
    )


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """fx_nodes, one node per supplier."""
    rows = table(spark, folder, "supplier").selectExpr(
        "concat('node-', s_suppkey) AS node_id",
        "s_suppkey AS node_pos",
        "s_suppkey % 4 = 0 AS is_for_profiling",
        "s_acctbal / 10000 AS cost",
        "CASE WHEN s_suppkey % 2 = 0 THEN concat('http://worker-', s_suppkey, ':8001') END AS worker_url",
        "CAST(s_nationkey % 5 AS INT) AS a40",
        "CAST(s_suppkey % 3 AS INT) AS l40s",
    )
    listed = F.array(
        F.struct(F.lit("A40").alias("gpu_type"), F.col("a40").alias("gpu_count")),
        F.struct(F.lit("L40S").alias("gpu_type"), F.col("l40s").alias("gpu_count")),
    ).cast(schemas.RESOURCES)
    return rows.withColumn("resources", F.filter(listed, lambda r: r["gpu_count"] > 0)).drop("a40", "l40s")


CLAIM_ORDER = ["created_at", "_orderkey", "_linenumber", "_partkey", "_suppkey", "_price"]


def claim_columns(lineitem: DataFrame) -> DataFrame:
    """A claim per lineitem that names GPUs, with the columns that order them."""
    return lineitem.selectExpr(
        "concat('type-', l_partkey % 40) AS job_id",
        "CAST(l_linenumber % 5 AS INT) AS a40",
        "CAST(l_suppkey % 3 AS INT) AS l40s",
        "concat('job-', l_orderkey) AS instance_id",
        "concat('node-', l_suppkey) AS node_id",
        "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 10 END AS duration_seconds",
        "l_shipdate AS created_at",
        "l_orderkey AS _orderkey",
        "l_linenumber AS _linenumber",
        "l_partkey AS _partkey",
        "l_suppkey AS _suppkey",
        "l_extendedprice AS _price",
        "l_quantity AS _quantity",
    ).where("a40 + l40s > 0")


def claim_feed(spark: SparkSession, folder: str, all_configs: bool = False) -> DataFrame:
    """Every claim made. A third of the configurations stays unclaimed unless ``all_configs``."""
    rows = claim_columns(table(spark, folder, "lineitem"))
    return rows if all_configs else rows.where("(_partkey % 40 + a40 + l40s) % 3 <> 0")


def with_config(rows: DataFrame) -> DataFrame:
    """Replace the count columns by the configuration and its key."""
    counted = rows.withColumn("gpu_config", _config())
    return counted.withColumn("config_key", config_key("gpu_config")).drop("a40", "l40s")


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """fx_claims, the first claim per type and configuration.

    The remainders above make at most 40 x 5 x 3 of those, so their earliest times can be
    broadcast, and only rows of the earliest time are compared in full.
    """
    feed, group = claim_feed(spark, folder), ["job_id", "a40", "l40s"]
    earliest = feed.groupBy(*group).agg(F.min("created_at").alias("created_at"))
    candidates = feed.join(F.broadcast(earliest), [*group, "created_at"], "left_semi")
    first = first_by(candidates, group, CLAIM_ORDER)
    return with_config(first).select(
        "job_id", "instance_id", "gpu_config", "config_key", "node_id", "duration_seconds", "created_at"
    )


def types(spark: SparkSession, folder: str) -> DataFrame:
    """Every job type."""
    return jobs(spark, folder).select("job_id").distinct()


def costs(spark: SparkSession) -> DataFrame:
    """fx_costs, as an inline table whose size the planner knows."""
    rows = ", ".join(f"('{gpu}', {n}, {price}D)" for gpu, n, price in GPU_COSTS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS costs(gpu_type, n_gpus, eur_per_hour)")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """fx_log, one run per user. Epoch lines of a run are numbered in order."""
    events = table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "value", (F.col("event_type") == "error").alias("_other")
    )
    cut_by = (table(spark, folder, "events"), ["user_id"])
    numbered = with_ordered(
        events, ["user_id", "_other"], ["ts", "event_id"], {"_epoch": row_number()}, cut_by=cut_by
    )
    return numbered.selectExpr(
        "event_id",
        "event_id AS line_no",
        "concat('job-', user_id) AS run_id",
        "ts",
        """CASE WHEN _other THEN 'Checkpoint saved' ELSE concat('2024-01-01 00:00:00 - __main__ - INFO - Epoch ', _epoch,
            '/500 - Loss: ', CAST(value AS DECIMAL(12,2)), ' - Acc: ', CAST(event_id % 100 AS DECIMAL(5,2)),
            '% - 1.00s') END AS line""",
    )


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Run, time and number of every line of fx_log, without the line."""
    return table(spark, folder, "events").selectExpr(
        "concat('job-', user_id) AS run_id", "ts", "event_id AS line_no"
    )


def restarting_log(spark: SparkSession, folder: str) -> DataFrame:
    """fx_log with a restart wherever it has a checkpoint line."""
    start = F.when(F.col("line") == "Checkpoint saved", "Starting training from epoch 0 to 500")
    return log(spark, folder).withColumn("line", start.otherwise(F.col("line")))


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Start and end of each run."""
    return (
        table(spark, folder, "events")
        .groupBy(F.concat(F.lit("job-"), "user_id").alias("run_id"))
        .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    )


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batch losses in eight epochs per run; every fifth event is not a batch."""
    return (
        table(spark, folder, "events")
        .where("event_type <> 'error'")
        .selectExpr("concat('job-', user_id) AS run_id", "1 + event_id % 8 AS epoch", "CAST(value AS DECIMAL(12,2)) AS loss")
    )


def commands(spark: SparkSession, folder: str) -> DataFrame:
    """Stop and resume commands, one per event, some to unknown jobs and some unknown; the newest of a job has the
    highest number."""
    return table(spark, folder, "events").selectExpr(
        "concat(CASE WHEN user_id % 25 = 3 THEN 'ghost-' ELSE 'job-' END, user_id) AS id",
        "event_id AS seq",
        "CASE WHEN event_type IN ('signup', 'purchase') THEN 'resume' WHEN event_id % 10 = 7 THEN 'pause' ELSE 'stop' END AS cmd",
    )


#: How long a log is silent before its session is over.
SILENCE = "12 hours"


def status_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Status changes of jobs: the events that are no plain views."""
    return table(spark, folder, "events").where("event_type <> 'view'").selectExpr(
        "concat('job-', user_id) AS run_id",
        "ts AS since",
        "event_id",
        "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'click' THEN 'RUNNING' ELSE 'QUEUED' END AS status",
    )


def node_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs on nodes, one per lineitem, as many days as its quantity."""
    runs_ = table(spark, folder, "lineitem").selectExpr(
        "concat('node-', l_suppkey) AS node_id",
        "l_shipdate AS start",
        "l_shipdate + make_dt_interval(CAST(l_quantity AS INT)) AS end",
        "CAST(l_linenumber % 5 AS INT) AS a40",
        "CAST(l_suppkey % 3 AS INT) AS l40s",
    )
    return runs_.select("node_id", "start", "end", _config().alias("gpu_config"))


def downtimes(spark: SparkSession, folder: str) -> DataFrame:
    """Times in which a node was down, one per twentieth order: days, or months for every third."""
    return table(spark, folder, "orders").where("o_orderkey % 20 = 0").selectExpr(
        "concat('node-', o_custkey % 100) AS node_id",
        "o_orderkey AS downtime",
        "o_orderdate AS start",
        "o_orderdate + make_dt_interval(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 200 ELSE o_orderkey % 9 END AS INT)) AS end",
    )


def job_versions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of some columns of fx_jobs: rows gone, rows twice, rows with another status or without a priority."""
    before = table(spark, folder, "orders").selectExpr(
        "concat('job-', o_orderkey) AS id", "o_orderstatus AS status", "CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority", "o_orderkey AS _n"
    )
    after = before.where("_n % 11 <> 7").selectExpr(
        "id",
        "CASE WHEN _n % 5 = 2 THEN 'X' ELSE status END AS status",
        "CASE WHEN _n % 13 <> 4 THEN priority END AS priority",
        "explode(sequence(0, CASE WHEN _n % 17 = 3 THEN 1 ELSE 0 END)) AS _copy",
    )
    return before.drop("_n"), after.drop("_copy")


def run_values(spark: SparkSession, folder: str) -> DataFrame:
    """The figure that each event of a run reports."""
    return table(spark, folder, "events").selectExpr("concat('job-', user_id) AS run_id", "event_id", "ts", "event_type", "value")
