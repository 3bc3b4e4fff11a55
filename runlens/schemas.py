"""Declared schemas; no reader infers one."""

from pyspark.sql import types as T

GPU_CONFIG = T.MapType(T.StringType(), T.IntegerType())

RESOURCES = T.ArrayType(
    T.StructType([T.StructField("gpu_type", T.StringType()), T.StructField("gpu_count", T.IntegerType())])
)

JOBS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("job_id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("command", T.ArrayType(T.StringType())),
        T.StructField("script_path", T.StringType()),
        T.StructField("directory_to_mount", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("container_name", T.StringType()),
        T.StructField("exit_code", T.IntegerType()),
        T.StructField("progress", T.StringType()),
        T.StructField("priority", T.IntegerType()),
        T.StructField("deadline", T.TimestampType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("epochs_total", T.IntegerType()),
        T.StructField("profiling_epochs_no", T.IntegerType()),
        T.StructField("assigned_node", T.StringType()),
        T.StructField("assigned_gpu_config", GPU_CONFIG),
        T.StructField("is_profiling_run", T.BooleanType()),
    ]
)

CLAIMS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("instance_id", T.StringType()),
        T.StructField("gpu_config", GPU_CONFIG),
        T.StructField("node_id", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

# As written in the inventory file.
NODES_FILE = T.ArrayType(
    T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("isForProfiling", T.BooleanType()),
            T.StructField("is_for_profiling", T.BooleanType()),
            T.StructField("cost", T.DoubleType()),
            T.StructField("workerUrl", T.StringType()),
            T.StructField("worker_url", T.StringType()),
            T.StructField("resources", RESOURCES),
        ]
    )
)

#: A node of an inventory by lines, as DDL.
NODE_LINE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES_FILE.elementType) + ", position bigint"

NODES = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("node_pos", T.LongType()),
        T.StructField("is_for_profiling", T.BooleanType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("worker_url", T.StringType()),
        T.StructField("resources", RESOURCES),
    ]
)

GPU_COSTS_FILE = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))

GPU_COSTS = T.StructType(
    [
        T.StructField("gpu_type", T.StringType()),
        T.StructField("n_gpus", T.IntegerType()),
        T.StructField("eur_per_hour", T.DoubleType()),
    ]
)

# As posted, every field as text: a value of the wrong type can then be told from a missing one. read_submissions
# converts and renames the columns.
BROKEN_LINE = "_broken"
SUBMISSIONS_FILE = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "job_id",
            "dockerImage",
            "scriptPath",
            "directoryToMount",
            "command",
            "Priority",
            "deadline",
            "batchSize",
            "profilingEpochsNo",
            "epochsTotal",
            BROKEN_LINE,
        )
    ]
)

# One line of a run's output, as delivered to a stream.
LOG_LINES = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line", T.StringType()),
    ]
)
