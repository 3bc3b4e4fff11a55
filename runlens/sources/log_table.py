"""R-05 to R-07. Run logs as one table with a manifest, where there are too many jobs for a folder each.

Lines lie in Parquet files, dealt by a hash of their job into a fixed number of buckets and sorted by job and line. A manifest
holds one row per job and append: bucket, lines and bytes. So the size of a log, the lines before an append, and the
buckets to read come from the manifest; a log is found without listing the others, and numbered without sorting its lines.

An append is written as a whole, its manifest last; without one, its lines do not count. Written again under its number, it
replaces what a failed try left. Many small appends are folded with ``compact_log_table``.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.plans.ordered import DEFAULT, HotGroups, row_number, with_ordered
from runlens.sources.writers import LOG_CHUNK

BUCKETS = 256
LINES = "job_id string, n bigint, line string, append bigint, bucket int"
MANIFEST = "job_id string, bucket int, lines bigint, bytes bigint, append bigint"


def append_log_table(
    lines: DataFrame,
    path: str,
    append: int | None = None,
    buckets: int = BUCKETS,
    chunk: int = LOG_CHUNK,
    hot: HotGroups = DEFAULT,
) -> None:
    """R-07. Append lines (job_id, line_no, line), which come after those of appends with lower numbers (by default the time).

    A table keeps one number of buckets. A log of more than ``chunk`` lines is written by several tasks. A NULL line is an
    empty one; lines without a job are left out; other columns are not stored.
    """
    place = time.time_ns() if append is None else append
    kept = lines.where("job_id IS NOT NULL").select("job_id", "line_no", F.coalesce("line", F.lit("")).alias("line"))
    numbered = with_ordered(kept, ["job_id"], ["line_no", "line"], {"n": row_number()}, hot)
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")
    placed = numbered.select("job_id", "n", "line", bucket.alias("bucket"))
    placed = placed.repartition("bucket", F.floor((F.col("n") - 1) / chunk)).sortWithinPartitions("bucket", "job_id", "n")
    spark, folder = lines.sparkSession, f"{path}/lines/append={place}"
    placed.write.partitionBy("bucket").mode("overwrite").parquet(folder)
    stored = spark.read.schema("job_id string, line string, bucket int").parquet(folder)
    size = F.sum(F.octet_length("line") + 1).cast("bigint")
    counted = stored.groupBy("job_id", "bucket").agg(F.count(F.lit(1)).alias("lines"), size.alias("bytes"))
    counted.write.mode("overwrite").parquet(f"{path}/manifest/append={place}")


def log_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per job and append; none where nothing was written yet."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def log_table_sizes(spark: SparkSession, path: str) -> DataFrame:
    """R-06. (job_id, bytes) of every log, from the manifest alone."""
    return log_manifest(spark, path).groupBy("job_id").agg(F.sum("bytes").alias("bytes"))


def refused_in_table(spark: SparkSession, path: str, max_bytes: int = C.MAX_LOG_BYTES) -> DataFrame:
    """R-06. The logs above the limit, as (job_id, bytes)."""
    return log_table_sizes(spark, path).where(F.col("bytes") > max_bytes)


def read_log_table(
    spark: SparkSession, path: str, jobs: DataFrame | None = None, max_bytes: int | None = None
) -> DataFrame:
    """R-05. Lines (job_id, line_no, line), numbered over all appends of a job.

    With ``jobs`` (column id) only their buckets are opened: the manifest is asked first, and at most one number per
    bucket comes back. With ``max_bytes`` the logs above it are left out; ``refused_in_table`` names them. Lines
    meet the manifest by job and append; where that moves them, adaptive execution splits a hot log.
    """
    by_job = Window.partitionBy("job_id")
    before = by_job.orderBy("append").rowsBetween(Window.unboundedPreceding, -1)
    manifest = log_manifest(spark, path)
    if jobs is not None:
        manifest = manifest.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    wanted = manifest.select(
        "job_id", "append", "bucket",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("_before"),
        F.sum("bytes").over(by_job).alias("_bytes"),
    )
    if max_bytes is not None:
        wanted = wanted.where(F.col("_bytes") <= max_bytes)
    try:
        lines = spark.read.schema(LINES).parquet(f"{path}/lines")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], LINES)
    if jobs is not None:
        lines = lines.where(F.col("bucket").isin([r["bucket"] for r in manifest.select("bucket").distinct().collect()]))
    found = lines.join(wanted.drop("_bytes"), ["job_id", "append", "bucket"])
    return found.select("job_id", (F.col("_before") + F.col("n")).alias("line_no"), "line")


def compact_log_table(spark: SparkSession, path: str, to: str, buckets: int = BUCKETS) -> None:
    """Write the table again as one append of a new table; readers are pointed to it, as with ``write_version``."""
    append_log_table(read_log_table(spark, path), to, append=0, buckets=buckets)
