"""Checking submissions and turning them into job rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import constants as C
from runlens import schemas


def _submission_errors(now: Column, deadline: Column) -> Column:
    def below_one(name: str) -> Column:
        return F.col(name) < 1

    checks = {
        "job_id is required": F.col("job_id").isNull(),
        "image is required": F.col("image").isNull(),
        "invalid image name": ~F.col("image").rlike(C.IMAGE_PATTERN),
        "priority out of range": ~F.col("priority").between(C.PRIORITY_MIN, C.PRIORITY_MAX),
        "deadline in the past": deadline < now,
        "epochs_total below 1": below_one("epochs_total"),
        "profiling_epochs_no below 1": below_one("profiling_epochs_no"),
    }
    # A check on a missing optional value is NULL and so raises no error.
    return F.filter(F.array(*[F.when(c, F.lit(m)) for m, c in checks.items()]), lambda e: e.isNotNull())


def validate_submissions(submissions: DataFrame, now: Column) -> DataFrame:
    """S-01. Add ``errors`` and ``is_valid``. ``type_errors`` of R-08, where there are any, are among the errors.

    A deadline is compared by its clock time read as UTC, whatever zone it was written in.
    """
    wall = F.col("deadline_wall" if "deadline_wall" in submissions.columns else "deadline")
    errors = _submission_errors(now, wall)
    if "type_errors" in submissions.columns:
        # Of a line that is no JSON object nothing else can be said.
        broken = F.array_contains("type_errors", C.BROKEN_SUBMISSION)
        errors = F.when(broken, F.col("type_errors")).otherwise(F.concat("type_errors", errors))
    checked = submissions.withColumn("errors", errors)
    return checked.withColumn("is_valid", F.size("errors") == 0)


def normalise_submissions(submissions: DataFrame, now: Column) -> DataFrame:
    """S-02. Job rows of valid submissions that carry their ``id``. A script replaces the
    command."""
    scripted = F.length("script_path") > 0
    values = {
        "command": F.when(scripted, F.array(F.lit("python3"), F.col("script_path"))).otherwise(
            F.coalesce("command", F.array().cast("array<string>"))
        ),
        "status": F.lit(C.QUEUED),
        "created_at": now,
        "updated_at": now,
        "priority": F.coalesce("priority", F.lit(C.DEFAULT_PRIORITY)),
        "epochs_total": F.coalesce("epochs_total", F.lit(C.DEFAULT_EPOCHS_TOTAL)),
        "profiling_epochs_no": F.coalesce("profiling_epochs_no", F.lit(C.DEFAULT_PROFILING_EPOCHS)),
        "is_profiling_run": F.lit(False),
    }
    columns = []
    for schema_field in schemas.JOBS:
        name = schema_field.name
        if name in values:
            columns.append(values[name].alias(name))
        elif name in submissions.columns:
            columns.append(F.col(name))
        else:
            columns.append(F.lit(None).cast(schema_field.dataType).alias(name))
    return submissions.select(*columns)
