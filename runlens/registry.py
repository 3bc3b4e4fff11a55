"""The registered queries: each runs an operator over the whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import fixtures as fx
from runlens import functions as fn
from runlens import sources
from runlens.operators import capacity, changes, claims, configs, costs, filters, lifecycle, listing, runs, sketches, submissions, temporal
from runlens.plans import placement
from runlens.plans.ordered import row_number, with_ordered
from runlens.session import new_folder
from runlens.streaming import registered as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _free(spark: SparkSession, sf: str) -> DataFrame:
    return capacity.node_free(fx.nodes(spark, sf), capacity.gpu_usage(fx.jobs(spark, sf)))


def _configs(spark: SparkSession, sf: str) -> DataFrame:
    return configs.valid_configs(fx.nodes(spark, sf))


# Nodes and capacity


@query
def node_status(spark, sf):
    """S-06, J-01, F-13."""
    status = capacity.node_status(fx.nodes(spark, sf), fx.jobs(spark, sf))
    return status.select("node_id", fn.role().alias("role"), "status", "n_current_jobs")


@query
def node_current_jobs(spark, sf):
    """J-01, one row per node and job."""
    return capacity.node_current_jobs(fx.nodes(spark, sf), fx.jobs(spark, sf))


@query
def node_job_ids(spark, sf):
    """J-01 with lists of ids, in pages."""
    pages = capacity.node_job_ids(fx.nodes(spark, sf), fx.jobs(spark, sf), page_size=5)
    return pages.select("node_id", "page", "status", F.array_join("current_job_ids", ",").alias("current_job_ids"))


@query
def node_counts(spark, sf):
    """A-02."""
    return capacity.node_counts(capacity.node_status(fx.nodes(spark, sf), fx.jobs(spark, sf)))


@query
def gpu_usage(spark, sf):
    """A-03."""
    return capacity.gpu_usage(fx.jobs(spark, sf))


@query
def remaining_capacity(spark, sf):
    """J-02."""
    return capacity.remaining_capacity(fx.nodes(spark, sf), capacity.gpu_usage(fx.jobs(spark, sf)))


@query
def node_gpu_total(spark, sf):
    """A-04."""
    return capacity.node_gpu_total(fx.nodes(spark, sf)).select("node_id", "total_gpus")


@query
def routing(spark, sf):
    """J-09."""
    return capacity.route_jobs(fx.jobs(spark, sf), fx.nodes(spark, sf))


# Configurations


@query
def valid_configs(spark, sf):
    """C-01, C-02, F-01, F-02, F-06."""
    found = _configs(spark, sf)
    return found.select("config_key", "n_gpus", fn.format_gpu_config("gpu_config").alias("label"))


@query
def config_listing(spark, sf):
    """O-04, in the order configurations are profiled."""
    return listing.by_size(_configs(spark, sf)).select("n_gpus", "config_key")


@query
def configs_by_key(spark, sf):
    """O-04, in the order configurations are listed."""
    ranked = _configs(spark, sf).withColumn("place", F.row_number().over(Window.orderBy("config_key")))
    return listing.by_config_key(ranked).select("config_key", "n_gpus", "place")


@query
def production_configs(spark, sf):
    """C-01 over every node."""
    return configs.enumerate_configs(fx.nodes(spark, sf)).select("config_key", "n_gpus")


@query
def shared_configs(spark, sf):
    """C-02 with profiling nodes left out of production."""
    return configs.valid_configs(fx.nodes(spark, sf), production="non_profiling").select("config_key", "n_gpus")


@query
def restricted_configs(spark, sf):
    """C-02 where production nodes lack a GPU type that profiling nodes have: its configurations go."""
    lacking = F.when(F.col("is_for_profiling"), F.col("resources")).otherwise(
        F.filter("resources", lambda r: r["gpu_type"] == "A40")
    )
    nodes = fx.nodes(spark, sf).withColumn("resources", lacking)
    return configs.valid_configs(nodes, production="non_profiling").select("config_key", "n_gpus")


@query
def unprofiled_configs(spark, sf):
    """J-04, for the types with waiting jobs."""
    types = filters.waiting(fx.jobs(spark, sf))
    return configs.unprofiled_configs(types, _configs(spark, sf), fx.claims(spark, sf))


@query
def next_config(spark, sf):
    """W-03."""
    return configs.next_config(filters.waiting(fx.jobs(spark, sf)), _configs(spark, sf), fx.claims(spark, sf))


@query
def profiled_configs(spark, sf):
    """A-05."""
    return configs.profiled_configs(fx.claims(spark, sf)).select("job_id", "config_key")


@query
def measured_configs(spark, sf):
    """A-05, completed only."""
    return configs.profiled_configs(fx.claims(spark, sf), completed_only=True).select("job_id", "config_key")


@query
def coverage(spark, sf):
    """A-07."""
    covered = configs.coverage(fx.types(spark, sf), _configs(spark, sf), fx.claims(spark, sf))
    return covered.withColumns({c: F.round(c, 4) for c in ("claimed_pct", "completed_pct")})


@query
def best_config(spark, sf):
    """A-08."""
    return configs.best_config(fx.claims(spark, sf))


@query
def config_grid(spark, sf):
    """J-06, F-03."""
    grid = configs.config_grid(fx.types(spark, sf), _configs(spark, sf), fx.claims(spark, sf))
    return grid.select(
        "job_id", "config_key", "node_id", fn.format_duration("duration_seconds").alias("duration"), "status", "is_best"
    )


@query
def durations(spark, sf):
    """F-03, for durations with fractions, halves of the last digit among them."""
    seconds = "((l_orderkey * 7 + l_linenumber * 1250 + l_partkey * 31) % 900000) / 10000.0D AS seconds"
    rows = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", seconds)
    return rows.select("l_orderkey", "l_linenumber", fn.format_duration("seconds").alias("duration"))


@query
def energy_cost(spark, sf):
    """J-07, for each type and count of the claims."""
    parts = fx.claims(spark, sf).select("job_id", "config_key", F.explode("gpu_config").alias("gpu_type", "n_gpus"))
    return costs.energy_cost(parts, fx.costs(spark)).select(
        "job_id", "config_key", "gpu_type", "n_gpus", "eur_per_hour"
    )


@query
def config_cost(spark, sf):
    """A-12."""
    priced = costs.config_cost(fx.claims(spark, sf), fx.costs(spark))
    return priced.withColumns({"eur_per_hour": F.round("eur_per_hour", 6), "cost_eur": F.round("cost_eur", 6)})


@query
def best_fit(spark, sf):
    """J-03, for the configuration each waiting job asks for."""
    requests = filters.waiting(fx.jobs(spark, sf)).select("id", "config_key", F.col("assigned_gpu_config").alias("gpu_config"))
    fit = configs.fit_requests(requests, _free(spark, sf))
    return fit.select("id", "config_key", "node_id", "surplus")


@query
def best_fit_large(spark, sf):
    """J-03 with requests that no node can hold."""
    wanted = fx.table(spark, sf, "orders").selectExpr(
        "concat('job-', o_orderkey) AS id", "CAST(1 + o_custkey % 7 AS INT) AS a40", "CAST(o_orderkey % 4 AS INT) AS l40s"
    )
    fit = configs.fit_requests(fx.with_config(wanted), _free(spark, sf))
    return fit.select("id", "config_key", "node_id", "surplus")


@query
def best_fit_profiling(spark, sf):
    """J-03, valid configurations on profiling nodes."""
    return configs.best_fit(_configs(spark, sf), _free(spark, sf), profiling_only=True)


@query
def available_config(spark, sf):
    """J-05."""
    return configs.available_config(fx.types(spark, sf), fx.claims(spark, sf), _free(spark, sf))


@query
def results_by_duration(spark, sf):
    """O-03. A type has one result per configuration, so its window stays small."""
    order = Window.partitionBy("job_id").orderBy(F.asc_nulls_last("duration_seconds"), "config_key")
    ranked = fx.claims(spark, sf).withColumn("place", F.row_number().over(order))
    return listing.by_duration(ranked).select("job_id", "config_key", "node_id", "duration_seconds", "place")


# Placement


@query
def plan_round(spark, sf):
    """P-01, W-06, A-06."""
    return placement.plan_round(fx.jobs(spark, sf), fx.claims(spark, sf), fx.nodes(spark, sf))


@query
def claims_after_plan(spark, sf):
    """P-01, K-01. The claims once those the plan makes are in."""
    held = fx.claims(spark, sf)
    made = placement.planned_claims(placement.plan_round(fx.jobs(spark, sf), held, fx.nodes(spark, sf)), fx.now())
    merged = claims.merge_claims(held, made, ["instance_id"])
    return merged.select("job_id", "config_key", "instance_id", "node_id", "duration_seconds", "created_at")


@query
def plan_standard(spark, sf):
    """P-02."""
    return placement.plan_standard(fx.jobs(spark, sf), fx.claims(spark, sf), fx.nodes(spark, sf))


@query
def claims_per_instance(spark, sf):
    """A-06."""
    return claims.claims_per_instance(fx.jobs(spark, sf).select("id"), fx.claims(spark, sf))


# Jobs: filters and listings


@query
def waiting_jobs(spark, sf):
    """S-05, O-02."""
    return filters.waiting_jobs(fx.jobs(spark, sf)).select("id", "job_id", "created_at")


@query
def active_jobs(spark, sf):
    """S-06."""
    return filters.active_jobs(fx.jobs(spark, sf)).select("id", "status", "assigned_node", "config_key")


@query
def missed_queued(spark, sf):
    """S-07, O-02."""
    return filters.missed_queued(fx.jobs(spark, sf)).select("id", "created_at")


@query
def get_job(spark, sf):
    """S-04, S-09."""
    return filters.select_columns(filters.get_job(fx.jobs(spark, sf), "job-100"), "id", "status", "image")


@query
def newest_page(spark, sf):
    """O-01."""
    return listing.newest_page(fx.jobs(spark, sf), limit=50, offset=20).select("id", "status", "created_at")


@query
def table_view(spark, sf):
    """O-05."""
    view = listing.table_view(
        fx.jobs(spark, sf), sort_by="image", descending=True, filter_column="status", filter_text="run", page=2
    )
    return view.select("id", "image", "status")


@query
def status_counts(spark, sf):
    """A-01."""
    return listing.status_counts(fx.jobs(spark, sf))


@query
def representative_jobs(spark, sf):
    """W-02, F-12."""
    return listing.representative_jobs(fx.jobs(spark, sf))


@query
def search_status(spark, sf):
    """S-08."""
    return filters.search_status(fx.jobs(spark, sf), "uEu").select("id", "status")


@query
def job_listing(spark, sf):
    """S-10, F-07."""
    return listing.job_listing(fx.jobs(spark, sf))


@query
def job_flags(spark, sf):
    """S-03, F-08, F-12, F-14."""
    return fx.jobs(spark, sf).select(
        "id",
        fn.is_stoppable().alias("stoppable"),
        fn.is_resumable().alias("resumable"),
        fn.is_runnable().alias("runnable"),
        fn.status_rank().alias("rank"),
        fn.is_first_run().alias("first_run"),
        fn.container_name().alias("container"),
    )


@query
def run_env(spark, sf):
    """F-09."""
    env = fx.jobs(spark, sf).select("id", fn.run_env(worker=True).alias("env"))
    return env.select(
        "id",
        F.col("env")["EPOCHS_TOTAL"].alias("epochs_total"),
        F.col("env")["BATCH_SIZE"].alias("batch_size"),
        F.size("env").alias("n_settings"),
    )


@query
def uuid_and_mask(spark, sf):
    """F-10, F-11, over page addresses with and without credentials."""
    pages = fx.table(spark, sf, "pages").selectExpr(
        "page_id",
        "CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS url",
        """CASE WHEN page_id % 3 = 0 THEN url ELSE concat(substr(md5(url), 1, 8), '-', substr(md5(url), 9, 4), '-',
             substr(md5(url), 13, 4), '-', upper(substr(md5(url), 17, 4)), '-', substr(md5(url), 21, 12)) END AS ref""",
    )
    return pages.select("page_id", fn.mask_credentials("url").alias("masked"), fn.is_uuid("ref").alias("is_uuid"))


# Submissions and updates


@query
def validate_submissions(spark, sf):
    """S-01."""
    checked = submissions.validate_submissions(fx.submissions(spark, sf), fx.now())
    return checked.select("id", "is_valid", F.array_join("errors", "; ").alias("errors"))


@query
def normalise_submissions(spark, sf):
    """S-02, of the valid submissions."""
    valid = submissions.validate_submissions(fx.submissions(spark, sf), fx.now()).where("is_valid")
    rows = submissions.normalise_submissions(valid, fx.now())
    return rows.select(
        "id", "job_id", "status", F.array_join("command", " ").alias("command"), "created_at", "priority",
        "epochs_total", "profiling_epochs_no", "is_profiling_run",
    )


@query
def lifecycle_commands(spark, sf):
    """K-07, outcome of every command."""
    return lifecycle.apply_commands(fx.jobs(spark, sf), fx.commands(spark, sf)).drop("cmd")


@query
def commanded_jobs(spark, sf):
    """K-07, the jobs afterwards."""
    jobs = fx.jobs(spark, sf)
    outcomes = lifecycle.apply_commands(jobs, fx.commands(spark, sf))
    return lifecycle.commanded_jobs(jobs, outcomes, fx.now()).select("id", "status", "updated_at")


@query
def run_outcomes(spark, sf):
    """K-08, every exit reported twice."""
    exits = fx.table(spark, sf, "orders").where("o_orderkey % 10 <> 0").selectExpr(
        "concat('job-', o_orderkey) AS id", "CAST(o_custkey % 3 AS INT) AS exit_code"
    )
    ended = lifecycle.resolve_outcomes(fx.jobs(spark, sf), exits.union(exits), fx.now())
    return ended.select("id", "status", "exit_code", "is_profiling_run", "assigned_node", "config_key", "updated_at", "replan")


@query
def orphaned_jobs(spark, sf):
    """J-08, F-08."""
    live = fx.table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr(
        "concat('run-', substr(concat('job-', o_orderkey), 1, 8)) AS name"
    )
    return lifecycle.orphaned_jobs(fx.jobs(spark, sf), live)


@query
def patch_jobs(spark, sf):
    """K-04, the newest of many changes per job."""
    changes = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('job-', l_orderkey) AS id",
        "CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE concat(l_linenumber, '/', CAST(l_quantity AS INT)) END AS progress",
        "CAST(l_suppkey % 2 AS INT) AS exit_code",
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )
    newest = [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")]
    patched = lifecycle.patch_jobs(fx.jobs(spark, sf), changes, fx.now(), newest)
    return patched.select("id", "progress", "exit_code", "updated_at")


@query
def patch_unordered(spark, sf):
    """K-04, changes of a job sent twice and in no order: the greatest values are set."""
    changes = fx.table(spark, sf, "lineitem").selectExpr(
        "concat('job-', l_orderkey) AS id", "concat(l_linenumber, '/9') AS progress", "CAST(l_suppkey % 2 AS INT) AS exit_code"
    )
    patched = lifecycle.patch_jobs(fx.jobs(spark, sf), changes.union(changes), fx.now())
    return patched.select("id", "progress", "exit_code")


@query
def delete_jobs(spark, sf):
    """K-05, the jobs left."""
    gone = fx.jobs(spark, sf).where("status = 'SUCCEEDED'")
    left, _ = lifecycle.delete_jobs(fx.jobs(spark, sf), fx.claims(spark, sf), gone)
    return left.select("id", "status")


@query
def delete_job_claims(spark, sf):
    """K-05, the claims left."""
    gone = fx.jobs(spark, sf).where("status = 'SUCCEEDED'")
    _, left = lifecycle.delete_jobs(fx.jobs(spark, sf), fx.claims(spark, sf), gone)
    return left.select("job_id", "config_key", "instance_id")


@query
def clear_jobs(spark, sf):
    """K-06. The stored jobs before and after a new version without rows."""
    path = new_folder(spark, "cleared")
    before = sources.write_version(fx.jobs(spark, sf).select("id", "status"), f"{path}/v1")
    after = sources.write_version(lifecycle.clear(before), f"{path}/v2")
    both = before.withColumn("version", F.lit("before")).union(after.withColumn("version", F.lit("after")))
    return both.agg(
        F.count_if(F.col("version") == "before").alias("n_before"), F.count_if(F.col("version") == "after").alias("n_after")
    )


@query
def merge_claims(spark, sf):
    """K-01, the whole feed against the claims there are."""
    new = fx.with_config(fx.claim_feed(spark, sf, all_configs=True))
    merged = claims.merge_claims(fx.claims(spark, sf), new, fx.CLAIM_ORDER)
    return merged.select("job_id", "config_key", "instance_id", "node_id", "duration_seconds", "created_at")


@query
def complete_claims(spark, sf):
    """K-02."""
    results = fx.with_config(fx.claim_feed(spark, sf).where("duration_seconds IS NULL")).withColumn(
        "duration_seconds", F.col("_quantity") * 7
    )
    done = claims.complete_claims(fx.claims(spark, sf), results, ["_quantity", *fx.CLAIM_ORDER])
    return done.select("job_id", "config_key", "instance_id", "node_id", "duration_seconds")


@query
def release_claims(spark, sf):
    """K-03."""
    failed = fx.jobs(spark, sf).where("status = 'FAILED'")
    left = claims.release_claims(fx.claims(spark, sf), failed)
    return left.select("job_id", "config_key", "duration_seconds")


# Stored tables


@query
def stored_jobs(spark, sf):
    """R-03, R-09. The jobs written and read back, with defaults for missing values."""
    path = new_folder(spark, "jobs")
    rows = fx.jobs(spark, sf).withColumns(
        {c: F.col(c).cast("timestamp") for c in ("created_at", "updated_at", "deadline")}
    )
    sources.append_rows(rows.drop("config_key"), path, partition_by="status")
    return sources.read_jobs(spark, path).select(
        "id", "job_id", "status", "priority", "epochs_total", "profiling_epochs_no", "config_key"
    )


@query
def stored_claims(spark, sf):
    """R-04."""
    path = new_folder(spark, "claims")
    rows = fx.claims(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp"))
    sources.append_rows(rows.drop("config_key"), path)
    return sources.read_claims(spark, path).select("job_id", "config_key", "node_id", "duration_seconds")


@query
def stored_inventory(spark, sf):
    """R-01. The inventory written as one JSON object per node and read back."""
    path = new_folder(spark, "inventory")
    node = F.struct(
        F.col("node_pos").alias("position"),
        F.col("node_id").alias("id"),
        F.col("is_for_profiling").alias("isForProfiling"),
        "cost",
        F.col("worker_url").alias("workerUrl"),
        "resources",
    )
    fx.nodes(spark, sf).select(F.to_json(node).alias("value")).write.text(path)
    nodes = capacity.node_gpu_total(sources.read_node_lines(spark, path))
    return nodes.select("node_id", "node_pos", "is_for_profiling", F.round("cost", 6).alias("cost"), "worker_url", "total_gpus")


@query
def priced_configs(spark, sf):
    """R-02, A-12. The price list written as a settings file, read back, and put on the measured configurations."""
    path = new_folder(spark, "prices")
    by_count = F.map_from_entries(F.collect_list(F.struct(F.col("n_gpus").cast("string"), "eur_per_hour")))
    by_type = fx.costs(spark).groupBy("gpu_type").agg(by_count.alias("prices"))
    listed = F.map_from_entries(F.collect_list(F.struct("gpu_type", "prices")))
    by_type.agg(F.to_json(listed).alias("value")).write.text(path)
    priced = costs.config_cost(fx.claims(spark, sf), sources.read_gpu_costs(spark, f"{path}/*.txt"))
    return priced.withColumns({"eur_per_hour": F.round("eur_per_hour", 6), "cost_eur": F.round("cost_eur", 6)})


@query
def stored_submissions(spark, sf):
    """R-08, S-01. Submissions written as they are posted: some with values of the wrong type or out of range, without
    an image or a type, and some lines that are no JSON."""
    path = new_folder(spark, "submissions")
    posted = fx.table(spark, sf, "orders").selectExpr(
        "o_orderkey % 60 AS k",
        "CASE WHEN o_orderkey % 60 = 1 THEN NULL ELSE concat('type-', o_custkey % 40) END AS job_id",
        "CASE WHEN o_orderkey % 60 = 2 THEN NULL WHEN o_orderkey % 60 = 3 THEN '../evil' ELSE 'img:v1' END AS image",
        """CASE o_orderkey % 60 WHEN 4 THEN '0' WHEN 5 THEN '6' WHEN 6 THEN '"high"' WHEN 7 THEN '4.5' WHEN 8 THEN '4.0'
             WHEN 9 THEN 'null' ELSE '3' END AS priority""",
        """CASE o_orderkey % 60 WHEN 10 THEN '"tomorrow"' WHEN 11 THEN '"1990-01-01T00:00:00+05:00"'
             WHEN 12 THEN '"1999-01-01T00:00:00Z"' ELSE 'null' END AS deadline""",
        "CASE o_orderkey % 60 WHEN 13 THEN '0' WHEN 14 THEN '[1]' ELSE '20' END AS epochs",
        "CASE o_orderkey % 60 WHEN 15 THEN '\"python x\"' ELSE '[\"python\", \"x\"]' END AS command",
    )
    line = """concat('{"job_id": ', coalesce(concat('"', job_id, '"'), 'null'), ', "dockerImage": ',
        coalesce(concat('"', image, '"'), 'null'), ', "Priority": ', priority, ', "deadline": ', deadline,
        ', "epochsTotal": ', epochs, ', "command": ', command, if(k = 16, '', '}'))"""
    posted.selectExpr(f"{line} AS value").write.text(path)
    checked = submissions.validate_submissions(sources.read_submissions(spark, path), fx.now().cast("timestamp"))
    by = ["job_id", "image", "priority", "is_valid", F.array_join("errors", "; ").alias("errors")]
    return checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("command")).cast("bigint").alias("n_words"))


def _stored_logs(spark: SparkSession, sf: str, write=sources.write_run_logs) -> tuple[DataFrame, str]:
    """fx_log with ids for its jobs and lines numbered per job, appended in two parts."""
    path = new_folder(spark, "logs")
    hashed = F.md5("run_id")
    parts = [F.substring(hashed, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    log = fx.log(spark, sf).drop("line_no").withColumn("job_id", F.concat_ws("-", *parts))
    log = with_ordered(log, ["job_id"], ["ts", "event_id"], {"line_no": row_number()})
    # Two appends and the jobs asked for read it, so it is put in order once.
    log = sources.write_version(log.select("job_id", "line_no", "line", "event_id"), new_folder(spark, "log"))
    for append, part in enumerate((F.col("line_no") <= 3, F.col("line_no") > 3)):
        write(log.where(part), path, append)
    return log, path


@query
def stored_run_logs(spark, sf):
    """R-05, R-07. Logs appended twice to a folder per job and read back in order for some of the jobs."""
    log, path = _stored_logs(spark, sf)
    known = log.where("line_no = 1 and event_id % 2 = 0").select(F.col("job_id").alias("id"))
    return sources.read_run_logs(spark, path, jobs=known).select("job_id", "line_no", "line")


@query
def guarded_run_logs(spark, sf):
    """R-06. Which logs a limit keeps and which it refuses, and how many lines are read."""
    _, path = _stored_logs(spark, sf)
    limit = 600
    kept = sources.read_run_logs(spark, path, max_bytes=limit).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_lines"))
    refused = sources.refused_logs(spark, path, limit).select("job_id", F.lit(0).cast("bigint").alias("n_lines"))
    return kept.withColumn("is_kept", F.lit(True)).union(refused.withColumn("is_kept", F.lit(False)))


def _write_table(lines: DataFrame, path: str, append: int) -> None:
    sources.append_log_table(lines, path, append, buckets=16)


@query
def log_table_lines(spark, sf):
    """R-05, R-07. As stored_run_logs, from one table with a manifest; only buckets of the jobs asked for are opened."""
    log, path = _stored_logs(spark, sf, _write_table)
    known = log.where("line_no = 1 and event_id % 2 = 0").select(F.col("job_id").alias("id"))
    return sources.read_log_table(spark, path, jobs=known)


@query
def log_table_guard(spark, sf):
    """R-06. As guarded_run_logs, decided by the manifest."""
    _, path = _stored_logs(spark, sf, _write_table)
    limit = 600
    kept = sources.read_log_table(spark, path, max_bytes=limit).groupBy("job_id").agg(F.count(F.lit(1)).alias("n_lines"))
    refused = sources.refused_in_table(spark, path, limit).select("job_id", F.lit(0).cast("bigint").alias("n_lines"))
    return kept.withColumn("is_kept", F.lit(True)).union(refused.withColumn("is_kept", F.lit(False)))


# Run logs


@query
def parse_progress(spark, sf):
    """F-04."""
    epoch, total = fn.progress("line")
    return fx.log(spark, sf).select("event_id", epoch.alias("epoch"), total.alias("total"))


@query
def epoch_lines(spark, sf):
    """F-05."""
    summaries = fx.log(spark, sf).where(fn.is_epoch_line("line"))
    rows = summaries.select("event_id", fn.epoch_line("line").alias("m"), fn.line_time("line").alias("at"))
    return rows.select("event_id", "m.*", F.col("at").cast("timestamp_ntz").alias("logged_at"))


@query
def latest_progress(spark, sf):
    """T-02, batch form."""
    return runs.latest_progress(fx.log(spark, sf))


@query
def epoch_intervals(spark, sf):
    """W-01."""
    steps = runs.epoch_intervals(runs.epoch_marks(fx.log(spark, sf)), log=fx.log_lines(spark, sf))
    return steps.withColumn("interval_seconds", F.round("interval_seconds", 3))


@query
def run_duration(spark, sf):
    """A-09."""
    took = runs.run_duration(runs.epoch_marks(fx.log(spark, sf)), fx.runs(spark, sf))
    return took.withColumn("duration_seconds", F.round("duration_seconds", 2))


@query
def best_so_far(spark, sf):
    """W-04."""
    return runs.best_so_far(runs.epoch_metrics(fx.log(spark, sf)), log=fx.log_lines(spark, sf))


@query
def attempts(spark, sf):
    """W-05."""
    segmented = runs.attempts(fx.restarting_log(spark, sf), counted=fx.log_lines(spark, sf))
    return segmented.select("event_id", "run_id", "attempt")


@query
def attempt_progress(spark, sf):
    """W-05, last progress of each attempt."""
    return runs.attempt_progress(runs.attempts(fx.restarting_log(spark, sf), counted=fx.log_lines(spark, sf)))


@query
def epoch_loss(spark, sf):
    """A-10."""
    epochs = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(8).cast("bigint")))
    spine = fx.runs(spark, sf).select("run_id", epochs.alias("epoch"))
    return runs.epoch_loss(fx.batches(spark, sf), spine).withColumn("loss", F.round("loss", 6))


@query
def accuracy(spark, sf):
    """A-11."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("embedding").alias("scores"), "label")
    return runs.accuracy(rows, guess=runs.argmax("scores") % 10).withColumn("accuracy", F.round("accuracy", 6))


@query
def accuracy_by_label(spark, sf):
    """A-11, per group."""
    rows = fx.table(spark, sf, "embeddings").select(F.col("embedding").alias("scores"), "label")
    return runs.accuracy(rows, "label", guess=runs.argmax("scores") % 10).withColumn("accuracy", F.round("accuracy", 6))


@query
def timeouts(spark, sf):
    """T-04, batch form."""
    late = runs.timeouts(fx.runs(spark, sf), fx.now(), limit_seconds=29 * 24 * 3600)
    return late.withColumn("elapsed_seconds", F.round("elapsed_seconds", 3))


# Over time


@query
def log_line_status(spark, sf):
    """As-of join: every log line with the status its job had then."""
    lines = fx.log_lines(spark, sf)
    found = temporal.as_of(lines, fx.status_changes(spark, sf), ["run_id"], "ts", ["status"], tie=["event_id"])
    return found.select("run_id", "line_no", "status")


@query
def runs_in_downtime(spark, sf):
    """Interval join: the runs on a node while it was down, and for how long."""
    met = temporal.overlapping(fx.node_runs(spark, sf), fx.downtimes(spark, sf), ["node_id"])
    hours = (F.unix_timestamp("to") - F.unix_timestamp("from")) / 3600
    return met.groupBy("node_id", "downtime").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(hours).alias("hours"))


@query
def peak_gpus(spark, sf):
    """A-03 over time: the most GPUs of each type in use on a node at once."""
    runs_ = fx.node_runs(spark, sf).select("node_id", "start", "end", F.explode("gpu_config").alias("gpu_type", "n"))
    return temporal.peak_use(runs_, ["node_id", "gpu_type"], "n")


@query
def log_sessions(spark, sf):
    """Session windows: stretches of a run's log without a silence of twelve hours."""
    return temporal.sessions(fx.log_lines(spark, sf), ["run_id"], "ts", fx.SILENCE)


@query
def stalled_runs(spark, sf):
    """The silences between a run's sessions."""
    return temporal.stalls(temporal.sessions(fx.log_lines(spark, sf), ["run_id"], "ts", fx.SILENCE), ["run_id"])


@query
def usage_rollup(spark, sf):
    """A-01 to A-03 in one pass, by grouping sets."""
    return capacity.usage_rollup(fx.jobs(spark, sf))


@query
def job_table_diff(spark, sf):
    """EXCEPT ALL both ways: the rows by which two versions of the jobs table differ."""
    return changes.table_diff(*fx.job_versions(spark, sf))


@query
def job_column_changes(spark, sf):
    """The values that changed between two versions of the jobs table."""
    return changes.column_changes(changes.table_diff(*fx.job_versions(spark, sf)), ["id"])


@query
def rolling_values(spark, sf):
    """RANGE frame: of every event, the mean and the most of its run's values in the twelve hours up to it."""
    rows = fx.run_values(spark, sf)
    figures = {"n_before": F.count(F.lit(1)), "mean": F.avg("value"), "most": F.max("value")}
    return temporal.rolling(rows, ["run_id"], "ts", 12 * 3600, figures).select("run_id", "event_id", *figures)


@query
def value_sketches(spark, sf):
    """Stored sketches per day, merged over all days: whether they keep to their error against exact figures."""
    rows = fx.run_values(spark, sf)
    stored = new_folder(spark, "sketches")
    sketches.daily_sketches(rows, ["event_type"], "ts", "value", "run_id").write.parquet(stored)
    found = sketches.estimates(sketches.merged(spark.read.parquet(stored), ["event_type"]), ["event_type"], 0.95)
    both = rows.join(found.withColumnRenamed("n", "n_merged"), "event_type")
    value = F.col("quantile_value")
    exact = both.groupBy("event_type", "n_merged").agg(
        F.avg((F.col("value") < value).cast("double")).alias("_below"),
        F.avg((F.col("value") <= value).cast("double")).alias("_upto"),
        F.countDistinct("run_id").alias("n_runs"),
        F.first("n_distinct").alias("_runs"),
    )
    near = (F.col("_below") - sketches.RANK_ERROR <= 0.95) & (F.col("_upto") + sketches.RANK_ERROR >= 0.95)
    count = F.abs(F.col("_runs") - F.col("n_runs")) <= F.ceil(F.col("n_runs") * sketches.COUNT_ERROR)
    return exact.select("event_type", "n_merged", "n_runs", near.alias("quantile_within"), count.alias("count_within"))


@query
def value_quantiles(spark, sf):
    """The exact figures that the sketches estimate."""
    rows = fx.run_values(spark, sf)
    return rows.groupBy("event_type").agg(F.percentile("value", 0.95).alias("quantile_value"), F.countDistinct("run_id").alias("n_distinct"))


QUERIES.update(streams.QUERIES)
