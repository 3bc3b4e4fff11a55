"""Run logs, epochs and training metrics.

A log has (run_id, line_no, ts, line); ``line_no`` breaks ties of ``ts``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import constants as C
from runlens.functions import attempt_start, epoch_line, has_progress, is_epoch_line, progress
from runlens.plans.ordered import (
    DEFAULT,
    HotGroups,
    Ordered,
    previous,
    row_number,
    running_max,
    running_sum,
    with_ordered,
)

ORDER = ["ts", "line_no"]


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one time to another, with fractions."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return micros / F.lit(1e6)


def epoch_marks(log: DataFrame) -> DataFrame:
    """Lines that report progress, with ``epoch`` and ``total``. The line itself is dropped, so
    what is shuffled later is narrow."""
    epoch, total = progress("line")
    marked = log.where(has_progress("line"))
    return marked.select("run_id", "line_no", "ts", epoch.alias("epoch"), total.alias("total"))


def epoch_metrics(log: DataFrame) -> DataFrame:
    """Epoch summary lines as columns."""
    rows = log.where(is_epoch_line("line")).select("run_id", "line_no", "ts", epoch_line("line").alias("m"))
    return rows.select("run_id", "line_no", "ts", "m.*")


def latest_progress(log: DataFrame) -> DataFrame:
    """T-02, batch form. The last reported progress of each run."""
    last = epoch_marks(log).groupBy("run_id").agg(
        F.max(F.struct(*ORDER, "epoch", "total")).alias("last")
    )
    text = F.concat(F.col("last.epoch").cast("string"), F.lit("/"), F.col("last.total").cast("string"))
    return last.select("run_id", text.alias("progress"))


def _by_run(
    rows: DataFrame, columns: dict[str, Ordered], hot: HotGroups, log: DataFrame | None
) -> DataFrame:
    """Columns ordered within each run. Lines of ``log``, when it is given, are counted to find
    the very long runs; that spares parsing every line once more for it."""
    return with_ordered(rows, ["run_id"], ORDER, columns, hot, cut_by=(rows if log is None else log, ["run_id"]))


def epoch_intervals(epochs: DataFrame, hot: HotGroups = DEFAULT, log: DataFrame | None = None) -> DataFrame:
    """W-01. Seconds between consecutive epochs; the first interval of a run is its warm-up."""
    steps = {"_n": row_number(), "_prev": previous("ts")}
    ordered = _by_run(epochs, steps, hot, log).where(F.col("_n") > 1)
    return ordered.select(
        "run_id",
        "line_no",
        "epoch",
        seconds_between(F.col("_prev"), F.col("ts")).alias("interval_seconds"),
        (F.col("_n") == 2).alias("is_warmup"),
    )


def run_summary(epochs: DataFrame) -> DataFrame:
    """What A-09 needs of each run: number of epoch lines, second and last time, last epoch.

    Both halves shrink the data before the shuffle. The second line comes from a window whose
    rank filter Spark also applies inside each input task, the rest is an ordinary aggregate.
    So a run that wrote most of the log leaves two rows per task.
    """
    whole = epochs.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_marks"), F.max(F.struct(*ORDER, "epoch")).alias("last")
    )
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(*ORDER))
    second = (
        epochs.select("run_id", *ORDER)
        .withColumn("_place", place)
        .where(F.col("_place") <= 2)
        .where(F.col("_place") == 2)
        .select("run_id", F.col("ts").alias("second_ts"))
    )
    return whole.join(second, "run_id", "left").select(
        "run_id", "n_marks", "second_ts", F.col("last.ts").alias("last_ts"), F.col("last.epoch").alias("last_epoch")
    )


def steady_duration(n_marks: Column, second_ts: Column, last_ts: Column, last_epoch: Column) -> Column:
    """The mean interval without the first, times the last epoch number. The sum of intervals
    telescopes to the last time minus the second."""
    enough = n_marks >= 3
    mean = seconds_between(second_ts, last_ts) / F.when(enough, n_marks - 2)
    return mean * last_epoch


def run_duration(epochs: DataFrame, runs: DataFrame) -> DataFrame:
    """A-09. Estimated duration of each run (run_id, started_at, ended_at).

    With fewer than three epoch lines it is the wall-clock time of the run.
    """
    joined = runs.join(run_summary(epochs), "run_id", "left")
    steady = steady_duration(*[F.col(c) for c in ("n_marks", "second_ts", "last_ts", "last_epoch")])
    wall = seconds_between(F.col("started_at"), F.col("ended_at"))
    return joined.select(
        "run_id",
        F.coalesce("n_marks", F.lit(0).cast("bigint")).alias("n_marks"),
        F.coalesce(steady, wall).alias("duration_seconds"),
    )


def best_so_far(metrics: DataFrame, hot: HotGroups = DEFAULT, log: DataFrame | None = None) -> DataFrame:
    """W-04. Best accuracy of the run up to each epoch."""
    best = _by_run(metrics, {"best_accuracy": running_max("accuracy")}, hot, log)
    return best.select("run_id", "line_no", "epoch", "accuracy", "best_accuracy")


def attempts(log: DataFrame, hot: HotGroups = DEFAULT, counted: DataFrame | None = None) -> DataFrame:
    """W-05. Number of the attempt each line belongs to: every (re)start begins a new one, and
    lines before the first start have 0."""
    first, _ = attempt_start("line")
    marked = log.withColumn("_start", F.when(first.isNotNull(), 1).otherwise(0))
    return _by_run(marked, {"attempt": running_sum("_start")}, hot, counted).drop("_start")


def attempt_progress(segmented: DataFrame) -> DataFrame:
    """W-05. Last progress per attempt; a restart resets it, so it may be NULL."""
    epoch, total = progress("line")
    mark = F.when(epoch.isNotNull(), F.struct(*ORDER, epoch.alias("epoch"), total.alias("total")))
    last = segmented.groupBy("run_id", "attempt").agg(F.count(F.lit(1)).alias("n_lines"), F.max(mark).alias("last"))
    return last.select(
        "run_id", "attempt", "n_lines", F.col("last.epoch").alias("epoch"), F.col("last.total").alias("total")
    )


def epoch_loss(batches: DataFrame, spine: DataFrame | None = None) -> DataFrame:
    """A-10. Mean batch loss per (run, epoch); 0.0 for epochs of the spine without batches."""
    summed = batches.groupBy("run_id", "epoch").agg(F.sum("loss").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    if spine is not None:
        summed = spine.select("run_id", "epoch").join(summed, ["run_id", "epoch"], "left")
    count = F.coalesce("_n", F.lit(0).cast("bigint"))
    total = F.coalesce(F.col("_sum").cast("double"), F.lit(0.0))
    return summed.select(
        "run_id", "epoch", count.alias("n_batches"), (total / F.greatest(count, F.lit(1))).alias("loss")
    )


def argmax(scores: Column | str) -> Column:
    """Position of the highest score, counted from 0; the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def accuracy(predictions: DataFrame, *by: str, guess: Column | None = None) -> DataFrame:
    """A-11. Percentage of rows whose guess, by default the highest score, is the label."""
    guess = argmax("scores") if guess is None else guess
    share = 100.0 * F.avg(F.when(guess == F.col("label"), 1.0).otherwise(0.0))
    return predictions.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), share.alias("accuracy"))


def timeouts(runs: DataFrame, now: Column, limit_seconds: int = C.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """T-04, batch form. Runs that have gone on, or went on, for longer than the limit."""
    took = seconds_between(F.col("started_at"), F.coalesce(F.col("ended_at"), now))
    return runs.withColumn("elapsed_seconds", took).where(F.col("elapsed_seconds") > limit_seconds)
