"""Small tables for tests."""

from datetime import UTC, datetime

from runlens import schemas
from runlens.sources import with_config_key, with_job_defaults

NOW = datetime(2026, 1, 1, tzinfo=UTC)


def nodes(spark, *rows):
    """Rows of (node_id, is_for_profiling, {gpu_type: count})."""
    listed = [
        (name, pos, prof, 0.0, None, [{"gpu_type": t, "gpu_count": n} for t, n in gpus.items()])
        for pos, (name, prof, gpus) in enumerate(rows)
    ]
    return spark.createDataFrame(listed, schemas.NODES)


def jobs(spark, *rows):
    """Rows given as dicts; what is left out is NULL."""
    defaults = {"job_id": "t", "image": "img:1", "status": "QUEUED", "created_at": NOW, "updated_at": NOW}
    names = schemas.JOBS.fieldNames()
    full = [tuple({**defaults, **row}.get(c) for c in names) for row in rows]
    return with_config_key(with_job_defaults(spark.createDataFrame(full, schemas.JOBS)), "assigned_gpu_config")


def claims(spark, *rows):
    """Rows of (job_id, config, duration, instance_id)."""
    full = [(None, job, inst, config, "n", duration, NOW) for job, config, duration, inst in rows]
    return with_config_key(spark.createDataFrame(full, schemas.CLAIMS), "gpu_config")


def rows(frame, *columns):
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)
