"""Known cases with known answers."""

from datetime import UTC, datetime, timedelta

import pytest
from helpers import NOW, claims, jobs, nodes, rows
from pyspark.sql import functions as F

from runlens import functions as fn
from runlens.operators import capacity, configs, costs, filters, lifecycle, listing, runs, submissions
from runlens.operators import claims as claim_ops
from runlens.plans.placement import plan_round, plan_standard


def keys(frame):
    return [r[0] for r in rows(frame, "config_key")]


def fit(spark, config, node_frame, job_frame=None, profiling_only=False):
    used = capacity.gpu_usage(job_frame if job_frame is not None else jobs(spark, {"id": "x", "status": "FAILED"}))
    free = capacity.node_free(node_frame, used)
    wanted = spark.createDataFrame([(config,)], "gpu_config map<string,int>")
    return configs.best_fit(wanted, free, profiling_only).first()["node_id"]


# Configurations


def test_config_key_ignores_entry_order(spark):
    frame = spark.createDataFrame([({"L40S": 1, "A40": 2},), ({"A40": 2, "L40S": 1},), (None,)], "m map<string,int>")
    found = frame.select(fn.config_key("m"), fn.format_gpu_config("m"), fn.config_total("m")).collect()
    assert [tuple(r) for r in found] == [('{"A40":2,"L40S":1}', "2× A40 + 1× L40S", 3)] * 2 + [(None, None, None)]


def test_two_by_three_gives_eleven_configs(spark):
    gpus = {"A40": 2, "L40S": 3}
    frame = nodes(spark, ("p", True, gpus), ("q", False, gpus))
    assert configs.valid_configs(frame).count() == 11
    assert configs.valid_configs(frame, production="non_profiling").count() == 11


def test_only_profiling_nodes_define_valid_configs(spark):
    frame = nodes(
        spark, ("a", True, {"A40": 1}), ("b", True, {"L40S": 1}), ("c", True, {"B": 1}), ("d", False, {"A40": 8, "L40S": 4})
    )
    assert keys(configs.valid_configs(frame)) == ['{"A40":1}', '{"B":1}', '{"L40S":1}']
    assert keys(configs.valid_configs(frame, production="non_profiling")) == ['{"A40":1}', '{"L40S":1}']


def test_no_nodes_or_no_resources_give_no_configs(spark):
    assert configs.valid_configs(nodes(spark)).count() == 0
    assert configs.valid_configs(nodes(spark, ("a", True, {}))).count() == 0


@pytest.mark.parametrize(("sizes", "count"), [({"A40": 4}, 4), ({"A40": 2, "L40S": 2}, 8), ({"L40S": 4, "A40": 4}, 24)])
def test_enumeration_per_node(spark, sizes, count):
    found = configs.enumerate_configs(nodes(spark, ("a", True, sizes)))
    assert found.count() == count == found.select("config_key").distinct().count()


def test_config_orders(spark):
    found = configs.valid_configs(nodes(spark, ("a", True, {"B": 2, "A": 1})))
    assert [r["config_key"] for r in listing.by_size(found).collect()] == [
        '{"A":1}', '{"B":1}', '{"A":1,"B":1}', '{"B":2}', '{"A":1,"B":2}',
    ]
    keys_only = [r["config_key"] for r in listing.by_config_key(found).collect()]
    assert keys_only == sorted(keys_only)


# Best fit


def test_best_fit_takes_the_tightest_node(spark):
    frame = nodes(spark, ("large", False, {"A40": 8}), ("medium", False, {"A40": 4}), ("small", False, {"A40": 2}))
    assert fit(spark, {"A40": 2}, frame) == "small"
    assert fit(spark, {"A40": 3}, frame) == "medium"
    assert fit(spark, {"A40": 9}, frame) is None


def test_best_fit_needs_every_type(spark):
    frame = nodes(spark, ("mixed", False, {"A40": 2, "Blackwell": 1}))
    assert fit(spark, {"A40": 1, "Blackwell": 1}, frame) == "mixed"
    assert fit(spark, {"Blackwell": 2}, frame) is None
    assert fit(spark, {"A40": 3}, frame) is None


def test_best_fit_counts_surplus_of_required_types_only(spark):
    frame = nodes(spark, ("a", False, {"A40": 3}), ("b", False, {"A40": 2, "L40S": 9}))
    assert fit(spark, {"A40": 2}, frame) == "b"


def test_best_fit_ties_go_to_the_first_listed(spark):
    frame = nodes(spark, ("z", False, {"A40": 2, "L40S": 1}), ("a", False, {"A40": 2}))
    assert fit(spark, {"A40": 1}, frame) == "z"


def test_best_fit_skips_full_nodes_and_uses_part_of_others(spark):
    frame = nodes(spark, ("full", False, {"A40": 2}), ("part", False, {"A40": 4}), ("free", False, {"A40": 8}))
    busy = jobs(
        spark,
        {"id": "1", "status": "RUNNING", "assigned_node": "full", "assigned_gpu_config": {"A40": 2}},
        {"id": "2", "status": "PROFILING", "assigned_node": "part", "assigned_gpu_config": {"A40": 2}},
        {"id": "3", "status": "QUEUED", "assigned_node": "free", "assigned_gpu_config": {"A40": 8}},
    )
    assert fit(spark, {"A40": 2}, frame, busy) == "part"
    assert fit(spark, {"A40": 3}, frame, busy) == "free"


def test_best_fit_on_profiling_nodes_only(spark):
    frame = nodes(spark, ("a", False, {"A40": 2}), ("p", True, {"A40": 8}))
    assert fit(spark, {"A40": 2}, frame) == "a"
    assert fit(spark, {"A40": 2}, frame, profiling_only=True) == "p"


def test_remaining_capacity_can_be_negative_and_ignores_strangers(spark):
    frame = nodes(spark, ("a", False, {"A40": 2}))
    busy = jobs(
        spark,
        {"id": "1", "status": "RUNNING", "assigned_node": "a", "assigned_gpu_config": {"A40": 3, "X": 1}},
        {"id": "2", "status": "RUNNING", "assigned_node": "gone", "assigned_gpu_config": {"A40": 3}},
    )
    assert rows(capacity.remaining_capacity(frame, capacity.gpu_usage(busy))) == [("a", "A40", 2, 3, -1)]


# Nodes


def test_node_status(spark):
    frame = nodes(spark, ("a", True, {"A40": 2}), ("b", False, {}))
    busy = jobs(
        spark,
        {"id": "j2", "status": "RUNNING", "assigned_node": "a"},
        {"id": "j1", "status": "PROFILING", "assigned_node": "a"},
        {"id": "j3", "status": "QUEUED", "assigned_node": "b"},
    )
    status = capacity.node_status(frame, busy)
    assert rows(status, "node_id", "status", "n_current_jobs") == [("a", "busy", 2), ("b", "idle", 0)]
    listed = capacity.node_job_ids(frame, busy)
    assert rows(listed, "node_id", "status", "current_job_ids") == [("a", "busy", ["j1", "j2"]), ("b", "idle", [])]
    paged = capacity.node_job_ids(frame, busy, page_size=1)
    assert rows(paged, "node_id", "page", "current_job_ids") == [("a", 0, ["j1"]), ("a", 1, ["j2"]), ("b", 0, [])]
    assert rows(capacity.node_current_jobs(frame, busy)) == [
        ("a", "busy", "j1"),
        ("a", "busy", "j2"),
        ("b", "idle", None),
    ]
    assert tuple(capacity.node_counts(status).first()) == (2, 1, 1)
    assert rows(capacity.node_gpu_total(frame), "node_id", "total_gpus") == [("a", 2), ("b", 0)]


def test_routing_is_null_without_node_or_address(spark):
    frame = nodes(spark, ("a", True, {})).withColumn("worker_url", F.lit("http://a"))
    listed = jobs(spark, {"id": "1", "assigned_node": "a"}, {"id": "2", "assigned_node": "b"}, {"id": "3"})
    assert rows(capacity.route_jobs(listed, frame), "id", "target_url") == [("1", "http://a"), ("2", None), ("3", None)]


# Costs


def test_energy_cost_lookup(spark):
    table = spark.createDataFrame([("A40", 1, 0.15), ("A40", 4, 0.54)], "gpu_type string, n_gpus int, eur_per_hour double")
    asked = spark.createDataFrame([("A40", 4), ("H100", 1), ("A40", 8)], "gpu_type string, n_gpus int")
    assert rows(costs.energy_cost(asked, table), "gpu_type", "n_gpus", "eur_per_hour") == [
        ("A40", 4, 0.54),
        ("A40", 8, None),
        ("H100", 1, None),
    ]


def test_config_cost_needs_every_price(spark):
    table = spark.createDataFrame([("A40", 1, 0.5), ("L", 2, 1.5)], "gpu_type string, n_gpus int, eur_per_hour double")
    measured = claims(spark, ("t", {"A40": 1, "L": 2}, 1800.0, "i"), ("t", {"A40": 1, "L": 3}, 1800.0, "i"))
    assert rows(costs.config_cost(measured, table), "config_key", "cost_eur") == [
        ('{"A40":1,"L":2}', 1.0),
        ('{"A40":1,"L":3}', None),
    ]


# Durations and metrics


def marks(spark, points, run="r"):
    data = [(run, i, e, datetime.fromtimestamp(t, UTC)) for i, (e, t) in enumerate(points)]
    return spark.createDataFrame(data, "run_id string, line_no long, epoch long, ts timestamp")


def one_run(spark, seconds, run="r"):
    start = datetime.fromtimestamp(0, UTC)
    return spark.createDataFrame([(run, start, start + timedelta(seconds=seconds))], "run_id string, started_at timestamp, ended_at timestamp")


def test_steady_duration_leaves_the_warm_up_out(spark):
    points = [(50, 10.0), (100, 15.0), (150, 19.0), (200, 23.0)]
    assert runs.run_duration(marks(spark, points), one_run(spark, 99)).first()["duration_seconds"] == 800.0
    steps = rows(runs.epoch_intervals(marks(spark, points)), "line_no", "interval_seconds", "is_warmup")
    assert steps == [(1, 5.0, True), (2, 4.0, False), (3, 4.0, False)]


@pytest.mark.parametrize("points", [[], [(50, 10.0)], [(50, 10.0), (100, 15.0)]])
def test_short_runs_use_wall_clock(spark, points):
    assert runs.run_duration(marks(spark, points), one_run(spark, 99)).first()["duration_seconds"] == 99.0


def test_repeated_epochs_count_and_equal_times_are_ordered_by_line(spark):
    points = [(1, 10.0), (1, 10.0), (1, 12.0), (2, 14.0), (3, 14.0)]
    assert runs.run_duration(marks(spark, points), one_run(spark, 9)).first()["duration_seconds"] == pytest.approx(4.0)


def test_epoch_loss_of_an_empty_epoch_is_zero(spark):
    batches = spark.createDataFrame([("r", 1, 2.0), ("r", 1, 4.0)], "run_id string, epoch int, loss double")
    spine = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, epoch int")
    assert rows(runs.epoch_loss(batches, spine)) == [("r", 1, 2, 3.0), ("r", 2, 0, 0.0)]
    assert rows(runs.epoch_loss(batches)) == [("r", 1, 2, 3.0)]


def test_accuracy_takes_the_first_of_equal_scores(spark):
    scored = spark.createDataFrame([([0.5, 0.5], 0), ([0.1, 0.9], 1), ([0.9, 0.1], 1)], "scores array<double>, label int")
    assert runs.accuracy(scored).first()["accuracy"] == pytest.approx(200 / 3)


def test_attempts_and_best_so_far(spark):
    lines = [
        "Starting training from epoch 0 to 5",
        "x - Epoch 1/5 - Loss: 0.500000 - Acc: 90.00% - 1.23s",
        "x - Epoch 2/5 - Loss: 0.400000 - Acc: 80.00% - 1.00s",
        "Starting training from epoch 2 to 5",
        "no progress yet",
        "Starting training from epoch 2 to 5",
        "x - Epoch 3/5 - Loss: 0.300000 - Acc: 95.50% - 1.00s",
    ]
    data = [("r", i, datetime.fromtimestamp(i, UTC), line) for i, line in enumerate(lines)]
    log = spark.createDataFrame(data, "run_id string, line_no long, ts timestamp, line string")
    segmented = runs.attempts(log)
    assert [r[1] for r in rows(segmented, "line_no", "attempt")] == [1, 1, 1, 2, 2, 3, 3]
    assert rows(runs.attempt_progress(segmented), "attempt", "n_lines", "epoch", "total") == [
        (1, 3, 2, 5),
        (2, 2, None, None),
        (3, 2, 3, 5),
    ]
    assert rows(runs.best_so_far(runs.epoch_metrics(log)), "epoch", "best_accuracy") == [(1, 90.0), (2, 90.0), (3, 95.5)]
    assert runs.latest_progress(log).first()["progress"] == "3/5"


def test_timeouts(spark):
    assert runs.timeouts(one_run(spark, 90_000), F.current_timestamp()).count() == 1
    assert runs.timeouts(one_run(spark, 86_400), F.current_timestamp()).count() == 0
    unended = one_run(spark, 5).withColumn("ended_at", F.lit(None).cast("timestamp"))
    assert runs.timeouts(unended, F.lit(datetime.fromtimestamp(90_000, UTC))).count() == 1


# Text functions


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("Epoch 50/10000", (50, 10000)),
        ("[Job abc123] Epoch 100/5000", (100, 5000)),
        ("Epoch   3/20 - then Epoch 4/20", (3, 20)),
        ("2026-01-01 00:00:00 - name - INFO - Epoch 3/20 - Loss: 0.1", (3, 20)),
        ("Training started", (None, None)),
        ("Epoch3/20", (None, None)),
        ("epoch 3/20", (None, None)),
        ("Epoch\t007/20x", (7, 20)),
    ],
)
def test_progress(spark, line, expected):
    epoch, total = fn.progress("line")
    assert tuple(spark.createDataFrame([(line,)], "line string").select(epoch, total).first()) == expected


def test_epoch_line(spark):
    text = "2026-01-01 00:00:05 - name - INFO - Epoch 3/20 - Loss: 0.123456 - Acc: 98.00% - 1.23s"
    frame = spark.createDataFrame([(text,), ("nothing",)], "line string")
    found = frame.select(fn.epoch_line("line").alias("m"), F.date_format(fn.line_time("line"), "HH:mm:ss").alias("at")).collect()
    assert tuple(found[0]["m"]) == (3, 20, 0.123456, 98.0, 1.23) and found[0]["at"] == "00:00:05"
    assert tuple(found[1]["m"]) == (None,) * 5 and found[1]["at"] is None


@pytest.mark.parametrize(
    ("seconds", "text"),
    [
        (5.5, "5.50s"),
        (59.0, "59.00s"),
        (60.0, "1m 0.00s"),
        (125.5, "2m 5.50s"),
        (0.125, "0.13s"),
        (1.005, "1.00s"),
        (59.999, "60.00s"),
        (7325.0, "122m 5.00s"),
        (None, None),
    ],
)
def test_format_duration(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "s double").select(fn.format_duration("s")).first()[0] == text


def test_ids_and_addresses(spark):
    frame = spark.createDataFrame(
        [("0f8fad5b-d9cb-469f-a165-70867728950E", "postgresql://u:p@h/db"), ("../evil", "http://h/x")], "id string, url string"
    )
    assert [tuple(r) for r in frame.select(fn.is_uuid("id"), fn.mask_credentials("url"), fn.short_id("id")).collect()] == [
        (True, "postgresql://*****@h/db", "0f8fad5b"),
        (False, "http://h/x", "../evil"),
    ]


@pytest.mark.parametrize(
    ("job", "env"),
    [
        ((True, 5, 20, None), {"EPOCHS_TOTAL": "5"}),
        ((True, None, 20, None), {"EPOCHS_TOTAL": "3"}),
        ((False, 2, 20, 64), {"EPOCHS_TOTAL": "20", "BATCH_SIZE": "64"}),
        ((False, 2, None, 0), {}),
    ],
)
def test_run_env(spark, job, env):
    schema = "is_profiling_run boolean, profiling_epochs_no int, epochs_total int, batch_size int"
    frame = spark.createDataFrame([job], schema)
    assert frame.select(fn.run_env()).first()[0] == env
    assert len(frame.select(fn.run_env(worker=True)).first()[0]) == len(env) + 3


def test_container_name(spark):
    frame = spark.createDataFrame([("0123456789", None), ("0123456789", ""), ("x", "own")], "id string, container_name string")
    assert [r[0] for r in frame.select(fn.container_name(prefix="p-")).collect()] == ["p-01234567", "p-01234567", "own"]


# Submissions


def submission(spark, **changes):
    row = {
        "id": "i", "job_id": "t", "image": "train-img:v1", "script_path": None, "command": ["a"], "priority": 3,
        "deadline": None, "epochs_total": 5, "profiling_epochs_no": 1, **changes,
    }
    schema = (
        "id string, job_id string, image string, script_path string, command array<string>, priority int,"
        " deadline timestamp, epochs_total int, profiling_epochs_no int"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


@pytest.mark.parametrize(
    ("changes", "valid"),
    [
        ({}, True),
        ({"image": "../evil"}, False),
        ({"image": "img; rm"}, False),
        ({"image": None}, False),
        ({"job_id": None}, False),
        ({"priority": 0}, False),
        ({"priority": 6}, False),
        ({"priority": 1}, True),
        ({"priority": None}, True),
        ({"deadline": NOW - timedelta(days=1)}, False),
        ({"deadline": NOW + timedelta(days=1)}, True),
        ({"epochs_total": 0}, False),
        ({"profiling_epochs_no": 0}, False),
    ],
)
def test_validation(spark, changes, valid):
    checked = submissions.validate_submissions(submission(spark, **changes), F.lit(NOW)).first()
    assert checked["is_valid"] is valid and bool(checked["errors"]) is not valid


def test_script_replaces_command(spark):
    for script, command in (("train.py", ["python3", "train.py"]), ("", ["a"]), (None, ["a"])):
        row = submissions.normalise_submissions(submission(spark, script_path=script, priority=None), F.lit(NOW)).first()
        assert (row["command"], row["status"], row["priority"], row["is_profiling_run"]) == (command, "QUEUED", 3, False)


# Lifecycle

MATRIX = [
    ("QUEUED", "stop", "stopped", "PREEMPTED", 202),
    ("RUNNING", "stop", "stop_requested", "PREEMPTED", 202),
    ("PROFILING", "stop", "stop_requested", "PREEMPTED", 202),
    ("PREEMPTED", "stop", "conflict", "PREEMPTED", 409),
    ("FAILED", "stop", "conflict", "FAILED", 409),
    ("SUCCEEDED", "stop", "conflict", "SUCCEEDED", 409),
    ("PREEMPTED", "resume", "resume_requested", "QUEUED", 202),
    ("FAILED", "resume", "resume_requested", "QUEUED", 202),
    ("QUEUED", "resume", "conflict", "QUEUED", 409),
    ("RUNNING", "resume", "conflict", "RUNNING", 409),
    ("PROFILING", "resume", "conflict", "PROFILING", 409),
    ("SUCCEEDED", "resume", "conflict", "SUCCEEDED", 409),
]


def test_command_matrix(spark):
    listed = jobs(spark, *[{"id": f"j{i}", "status": m[0]} for i, m in enumerate(MATRIX)])
    sent = spark.createDataFrame([(f"j{i}", 1, m[1]) for i, m in enumerate(MATRIX)] + [("none", 1, "stop")], "id string, seq long, cmd string")
    found = {r["id"]: r for r in lifecycle.apply_commands(listed, sent).collect()}
    for i, (before, _, outcome, after, code) in enumerate(MATRIX):
        r = found[f"j{i}"]
        assert (r["status_before"], r["outcome"], r["status_after"], r["code"]) == (before, outcome, after, code)
    assert (found["none"]["outcome"], found["none"]["code"]) == ("not_found", 404)


def test_ten_stop_and_resume_cycles(spark):
    listed = jobs(spark, {"id": "j", "status": "RUNNING"})
    sent = spark.createDataFrame([("j", i, ("stop", "resume")[i % 2]) for i in range(20)], "id string, seq long, cmd string")
    outcomes = lifecycle.apply_commands(listed, sent)
    assert outcomes.where("code <> 202").count() == 0
    assert lifecycle.commanded_jobs(listed, outcomes, F.lit(NOW)).first()["status"] == "QUEUED"


def test_run_outcomes(spark):
    listed = jobs(
        spark,
        {"id": "stopped", "status": "PREEMPTED"},
        {"id": "broken", "status": "RUNNING"},
        {"id": "measured", "status": "PROFILING", "is_profiling_run": True, "assigned_node": "n"},
        {"id": "done", "status": "RUNNING", "assigned_node": "n"},
        {"id": "going", "status": "RUNNING"},
    )
    ended = spark.createDataFrame([("stopped", 137), ("broken", 1), ("measured", 0), ("done", 0)], "id string, exit_code int")
    found = rows(lifecycle.resolve_outcomes(listed, ended, F.lit(NOW)), "id", "status", "exit_code", "assigned_node", "replan")
    assert found == [
        ("broken", "FAILED", 1, None, False),
        ("done", "SUCCEEDED", 0, "n", False),
        ("going", "RUNNING", None, None, False),
        ("measured", "QUEUED", None, None, True),
        ("stopped", "PREEMPTED", 137, None, False),
    ]


def test_orphans_fail_and_queued_jobs_are_left(spark):
    listed = jobs(
        spark,
        {"id": "aaaaaaaa-1", "status": "RUNNING", "assigned_node": "n"},
        {"id": "bbbbbbbb-1", "status": "PROFILING", "assigned_node": "n"},
        {"id": "cccccccc-1", "status": "RUNNING", "container_name": "own"},
        {"id": "dddddddd-1", "status": "QUEUED"},
    )
    live = spark.createDataFrame([("run-bbbbbbbb",), ("own",), ("own",)], "name string")
    assert rows(lifecycle.orphaned_jobs(listed, live), "id", "status") == [("aaaaaaaa-1", "FAILED")]
    assert lifecycle.orphaned_jobs(listed, live, node="other").count() == 0


def test_patch_delete_and_clear(spark):
    listed = jobs(spark, {"id": "a", "progress": "1/2"}, {"id": "b", "progress": "1/2"})
    later = NOW + timedelta(hours=1)
    changes = spark.createDataFrame([("a", 1, "2/2"), ("a", 2, None)], "id string, seq int, progress string")
    patched = lifecycle.patch_jobs(listed, changes, F.lit(later), newest=[F.col("seq")])
    # NULL is a value to set, and only the named job is touched.
    touched = (F.col("updated_at") == F.lit(later)).alias("touched")
    assert rows(patched, "id", "progress", touched) == [("a", None, True), ("b", "1/2", False)]
    assert patched.columns == listed.columns
    gone = spark.createDataFrame([("a",)], "id string")
    held = claims(spark, ("t", {"A": 1}, None, "a"), ("t", {"A": 2}, None, "b"))
    left_jobs, left_claims = lifecycle.delete_jobs(listed, held, gone)
    assert rows(left_jobs, "id") == [("b",)] and rows(left_claims, "instance_id") == [("b",)]
    assert lifecycle.clear(listed).count() == 0 and lifecycle.clear(listed).schema == listed.schema


# Claims


def test_first_claim_wins(spark):
    old = claims(spark, ("t", {"A": 1}, 5.0, "old"))
    new = claims(spark, ("t", {"A": 1}, None, "late"), ("t", {"A": 2}, None, "y"), ("t", {"A": 2}, None, "x"))
    merged = claim_ops.merge_claims(old, new, [F.col("instance_id")])
    assert rows(merged, "config_key", "instance_id") == [('{"A":1}', "old"), ('{"A":2}', "x")]


def test_completion_only_touches_claims_in_flight(spark):
    held = claims(spark, ("t", {"A": 1}, None, "i"), ("t", {"A": 2}, 5.0, "i"), ("t", {"A": 3}, None, "i"))
    results = claims(spark, ("t", {"A": 1}, 7.0, "1"), ("t", {"A": 1}, 8.0, "2"), ("t", {"A": 2}, 9.0, "1"))
    done = claim_ops.complete_claims(held, results.withColumn("node_id", F.lit("m")), [F.col("instance_id")])
    assert rows(done, "config_key", "duration_seconds", "node_id") == [
        ('{"A":1}', 7.0, "m"),
        ('{"A":2}', 5.0, "n"),
        ('{"A":3}', None, "n"),
    ]


def test_release_only_drops_claims_in_flight(spark):
    held = claims(spark, ("t", {"A": 1}, None, "i"), ("t", {"A": 2}, 5.0, "i"))
    failed = claims(spark, ("t", {"A": 1}, None, "x"), ("t", {"A": 1}, None, "y"), ("t", {"A": 2}, None, "x"))
    assert rows(claim_ops.release_claims(held, failed), "config_key") == [('{"A":2}',)]


def test_results_of_types(spark):
    frame = nodes(spark, ("p", True, {"A": 3}))
    held = claims(spark, ("t", {"A": 2}, 9.0, "i"), ("t", {"A": 3}, None, "i"), ("t", {"A": 1}, 9.0, "i"))
    types = spark.createDataFrame([("t",), ("new",)], "job_id string")
    valid = configs.valid_configs(frame)
    assert rows(configs.best_config(held), "job_id", "config_key") == [("t", '{"A":1}')]
    assert rows(configs.next_config(types, valid, held), "job_id", "config_key") == [("new", '{"A":1}')]
    covered = rows(configs.coverage(types, valid, held), "job_id", "claimed", "completed", "valid", "claimed_pct")
    assert covered == [("new", 0, 0, 3, 0.0), ("t", 3, 2, 3, 100.0)]
    none = configs.coverage(types, configs.valid_configs(nodes(spark)), held)
    assert none.where("claimed_pct IS NOT NULL").count() == 0
    assert [r["config_key"] for r in listing.by_duration(held).collect()] == ['{"A":1}', '{"A":2}', '{"A":3}']
    grid = rows(configs.config_grid(types.where("job_id = 't'"), valid, held), "config_key", "status", "is_best")
    assert grid == [('{"A":1}', "done", True), ('{"A":2}', "done", False), ('{"A":3}', "pending", False)]


# Placement


def plan_of(spark, job_frame, claim_frame, node_frame, **kw):
    return rows(plan_round(job_frame, claim_frame, node_frame, **kw), "id", "mode", "config_key", "node_id")


def test_one_claim_per_instance_then_standard(spark):
    frame = nodes(spark, ("p", True, {"A40": 2}))
    one = jobs(spark, {"id": "i1"})
    assert plan_of(spark, one, claims(spark), frame) == [("i1", "profiling", '{"A40":1}', "p")]
    measured = claims(spark, ("t", {"A40": 1}, 10.0, "i1"))
    assert plan_of(spark, one, measured, frame) == [("i1", "standard", '{"A40":1}', "p")]
    two = jobs(spark, {"id": "i1"}, {"id": "i2", "created_at": NOW + timedelta(seconds=1)})
    assert plan_of(spark, two, measured, frame) == [
        ("i1", "standard", '{"A40":1}', "p"),
        ("i2", "profiling", '{"A40":2}', "p"),
    ]


def test_an_unplaceable_config_holds_its_type_up(spark):
    frame = nodes(spark, ("p", True, {"A40": 2}), ("q", False, {"A40": 8}))
    waiting = [{"id": f"i{n}", "created_at": NOW + timedelta(seconds=n)} for n in range(3)]
    busy = {"id": "b", "status": "RUNNING", "assigned_node": "p", "assigned_gpu_config": {"A40": 1}, "job_id": "u"}
    assert plan_of(spark, jobs(spark, *waiting, busy), claims(spark), frame) == [
        ("i0", "profiling", '{"A40":1}', "p"),
        ("i1", "profiling", '{"A40":2}', None),
        ("i2", "profiling", '{"A40":2}', None),
    ]


def test_every_config_is_visited_once(spark):
    frame = nodes(spark, ("p", True, {"A": 2, "B": 1}))
    waiting = [{"id": f"i{n}", "created_at": NOW + timedelta(seconds=n)} for n in range(8)]
    planned = plan_of(spark, jobs(spark, *waiting), claims(spark), frame)
    profiled = [p[2] for p in planned if p[1] == "profiling"]
    assert len(profiled) == len(set(profiled)) == 5
    assert [p[1:] for p in planned[5:]] == [("standard", None, None)] * 3


def test_standard_plan_uses_the_type(spark):
    frame = nodes(spark, ("p", True, {"A": 2}))
    held = claims(spark, ("t", {"A": 2}, 1.0, "x"), ("t", {"A": 1}, None, "x"))
    planned = plan_standard(jobs(spark, {"id": "i"}, {"id": "k", "job_id": "u"}), held, frame)
    assert rows(planned, "id", "config_key", "node_id") == [("i", '{"A":2}', "p"), ("k", None, None)]


# Listings


def test_listings(spark):
    listed = jobs(
        spark,
        *[{"id": f"j{n}", "created_at": NOW + timedelta(days=n % 3), "status": s, "job_id": f"t{n % 2}"}
          for n, s in enumerate(["QUEUED", "RUNNING", "FAILED", "QUEUED", "SUCCEEDED", "PREEMPTED"])],
    )
    assert [r["id"] for r in listing.newest_page(listed, 3, 1).collect()] == ["j5", "j1", "j4"]
    assert [r["id"] for r in filters.waiting_jobs(listed).collect()] == ["j0", "j3"]
    assert tuple(listing.status_counts(listed).first()) == (6, 2, 0, 1, 2)
    assert tuple(listing.status_counts(listed, newest=2).first()) == (2, 0, 0, 0, 1)
    assert rows(listing.representative_jobs(listed), "job_id", "id") == [("t0", "j0"), ("t1", "j1")]
    assert rows(filters.search_status(listed, "EU"), "id") == [("j0",), ("j3",)]
    view = listing.table_view(listed, "status", descending=True, page=1, page_size=2)
    assert [r["id"] for r in view.collect()] == ["j0", "j3"]
    for limit, offset in ((0, 0), (501, 0), (1, -1)):
        with pytest.raises(ValueError):
            listing.newest_page(listed, limit, offset)
    shown = listing.job_listing(listed.where("id = 'j0'")).first()
    assert (shown["progress"], shown["deadline"], shown["created"], shown["epochs"]) == ("—", "—", "01/01 00:00", "20")
