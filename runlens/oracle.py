"""The registered queries as SQL for DuckDB, over the same tables."""

from __future__ import annotations

from runlens.fixtures import GPU_COSTS, NOW

NOW_SQL = f"TIMESTAMP '{NOW}'"

JOBS = """fx_jobs AS (
 SELECT 'job-' || o_orderkey AS id, 'type-' || (o_custkey % 40) AS job_id,
  CASE WHEN o_orderkey % 17 = 0 THEN '../evil' ELSE 'train-img:v' || (o_custkey % 7) END AS image,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'SUCCEEDED' WHEN o_orderstatus = 'F' THEN 'FAILED'
       WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'QUEUED' WHEN o_orderstatus = 'O' THEN 'PREEMPTED'
       WHEN o_orderkey % 2 = 0 THEN 'RUNNING' ELSE 'PROFILING' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL '2' DAY
       ELSE o_orderdate - INTERVAL '1' DAY END AS deadline,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) END AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(10 + o_orderkey % 20 AS INT) END AS epochs_total,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 25 = 0 THEN 'node-' || (o_custkey % 100) END AS assigned_node,
  CAST(1 + o_custkey % 2 AS INT) AS a40, CAST(o_orderkey % 2 AS INT) AS l40s,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'train' || (o_orderkey % 3) || '.py' END AS script_path,
  CASE WHEN o_orderkey % 6 = 0 THEN 0 WHEN o_orderkey % 6 = 1 THEN NULL ELSE CAST(16 * (o_orderkey % 6) AS INT) END AS batch_size,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(1 + o_orderkey % 5 AS INT) END AS profiling_epochs_no,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 3 AS INT) END AS exit_code
 FROM orders)"""


def key(prefix: str = "") -> str:
    a, b = f"{prefix}a40", f"{prefix}l40s"
    return (
        f"CASE WHEN {a} > 0 AND {b} > 0 THEN '{{\"A40\":' || {a} || ',\"L40S\":' || {b} || '}}' "
        f"WHEN {a} > 0 THEN '{{\"A40\":' || {a} || '}}' WHEN {b} > 0 THEN '{{\"L40S\":' || {b} || '}}' END"
    )


def label(prefix: str = "") -> str:
    a, b = f"{prefix}a40", f"{prefix}l40s"
    return (
        f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} || '× A40 + ' || {b} || '× L40S' "
        f"WHEN {a} > 0 THEN {a} || '× A40' ELSE {b} || '× L40S' END"
    )


NODES = """fx_nodes AS (
 SELECT 'node-' || s_suppkey AS node_id, s_suppkey AS node_pos, s_suppkey % 4 = 0 AS is_for_profiling,
  s_acctbal / 10000 AS cost, CASE WHEN s_suppkey % 2 = 0 THEN 'http://worker-' || s_suppkey || ':8001' END AS worker_url,
  CAST(s_nationkey % 5 AS INT) AS a40, CAST(s_suppkey % 3 AS INT) AS l40s FROM supplier)"""

FEED = """fx_feed AS (
 SELECT *, 'type-' || (l_partkey % 40) AS job_id, CAST(l_linenumber % 5 AS INT) AS a40, CAST(l_suppkey % 3 AS INT) AS l40s,
  'job-' || l_orderkey AS instance_id, 'node-' || l_suppkey AS node_id,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_quantity * 10 END AS duration_seconds, l_shipdate AS created_at
 FROM lineitem WHERE CAST(l_linenumber % 5 AS INT) + CAST(l_suppkey % 3 AS INT) > 0)"""

FEED_ORDER = "created_at, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

CLAIMS = f"""{FEED}, fx_claims AS (
 SELECT job_id, a40, l40s, {key()} AS config_key, instance_id, node_id, duration_seconds, created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id, a40, l40s ORDER BY {FEED_ORDER}) AS rn
  FROM fx_feed WHERE (l_partkey % 40 + a40 + l40s) % 3 <> 0) WHERE rn = 1)"""

LOG = """fx_log AS (
 SELECT event_id, 'job-' || user_id AS run_id, ts,
  CASE WHEN event_type = 'error' THEN 'Checkpoint saved'
   ELSE '2024-01-01 00:00:00 - __main__ - INFO - Epoch ' ||
    row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) || '/500 - Loss: ' ||
    CAST(value AS DECIMAL(12,2)) || ' - Acc: ' || CAST(event_id % 100 AS DECIMAL(5,2)) || '% - 1.00s' END AS line FROM events)"""

STORED_LOG = f"""{LOG}, h AS (SELECT *, md5(run_id) AS m FROM fx_log), l AS (SELECT event_id, line,
 row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS line_no,
 substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS job_id
 FROM h)"""

MARKS = f"""{LOG}, marks AS (
 SELECT run_id, event_id AS line_no, ts, CAST(regexp_extract(line, 'Epoch\\s+(\\d+)/(\\d+)', 1) AS BIGINT) AS epoch,
  CAST(regexp_extract(line, 'Epoch\\s+(\\d+)/(\\d+)', 2) AS BIGINT) AS total
 FROM fx_log WHERE regexp_matches(line, 'Epoch\\s+\\d+/\\d+'))"""

RUNS = """fx_runs AS (
 SELECT 'job-' || user_id AS run_id, min(ts) AS started_at, max(ts) AS ended_at FROM events GROUP BY user_id)"""

ACTIVE = "status IN ('RUNNING', 'PROFILING') AND assigned_node IS NOT NULL"
WAITING = "status = 'QUEUED' AND assigned_node IS NULL"

USAGE = f"""fx_usage AS (
 SELECT node_id, gpu_type, CAST(sum(n) AS BIGINT) AS used FROM (
  SELECT assigned_node AS node_id, 'A40' AS gpu_type, a40 AS n FROM fx_jobs WHERE {ACTIVE} AND a40 > 0
  UNION ALL SELECT assigned_node, 'L40S', l40s FROM fx_jobs WHERE {ACTIVE} AND l40s > 0) GROUP BY node_id, gpu_type)"""

FREE = f"""{NODES}, {JOBS}, {USAGE}, fx_free AS (
 SELECT n.node_id, n.node_pos, n.is_for_profiling,
  CASE WHEN n.a40 > 0 THEN n.a40 - coalesce(a.used, 0) ELSE 0 END AS free_a40,
  CASE WHEN n.l40s > 0 THEN n.l40s - coalesce(l.used, 0) ELSE 0 END AS free_l40s
 FROM fx_nodes n LEFT JOIN fx_usage a ON a.node_id = n.node_id AND a.gpu_type = 'A40'
 LEFT JOIN fx_usage l ON l.node_id = n.node_id AND l.gpu_type = 'L40S')"""


def enumerated(where: str) -> str:
    return (
        f"SELECT DISTINCT a.x AS a40, l.x AS l40s FROM fx_nodes n, generate_series(0, 4) a(x), generate_series(0, 2) l(x) "
        f"WHERE {where} AND a.x <= n.a40 AND l.x <= n.l40s AND a.x + l.x > 0"
    )


def configs(name: str = "fx_configs", where: str = "n.is_for_profiling") -> str:
    return (
        f"{name} AS (SELECT CAST(a40 AS INT) AS a40, CAST(l40s AS INT) AS l40s, CAST(a40 + l40s AS INT) AS n_gpus, "
        f"{key()} AS config_key FROM ({enumerated(where)}))"
    )


def fits(name: str, wanted: str, where: str = "true") -> str:
    """The tightest node per distinct (a40, l40s, config_key) of ``wanted``."""
    return f"""{name} AS (
 SELECT config_key, node_id, surplus FROM (
  SELECT c.config_key, f.node_id,
   CAST(CASE WHEN c.a40 > 0 THEN f.free_a40 - c.a40 ELSE 0 END + CASE WHEN c.l40s > 0 THEN f.free_l40s - c.l40s ELSE 0 END AS BIGINT) AS surplus,
   row_number() OVER (PARTITION BY c.config_key ORDER BY
    CASE WHEN c.a40 > 0 THEN f.free_a40 - c.a40 ELSE 0 END + CASE WHEN c.l40s > 0 THEN f.free_l40s - c.l40s ELSE 0 END, f.node_pos) AS rn
  FROM (SELECT DISTINCT a40, l40s, config_key FROM {wanted}) c JOIN fx_free f
   ON (c.a40 = 0 OR f.free_a40 >= c.a40) AND (c.l40s = 0 OR f.free_l40s >= c.l40s) AND {where}) WHERE rn = 1)"""


TYPES = "fx_types AS (SELECT DISTINCT job_id FROM fx_jobs)"
WAITING_TYPES = f"waiting_types AS (SELECT DISTINCT job_id FROM fx_jobs WHERE {WAITING})"

REM = f"""{NODES}, {JOBS}, {CLAIMS}, {configs()}, {WAITING_TYPES}, rem AS (
 SELECT t.job_id, c.config_key, c.n_gpus, row_number() OVER (PARTITION BY t.job_id ORDER BY c.n_gpus, c.config_key) AS rn
 FROM waiting_types t CROSS JOIN fx_configs c
 WHERE NOT EXISTS (SELECT 1 FROM fx_claims k WHERE k.job_id = t.job_id AND k.config_key = c.config_key))"""

BEST = """best AS (
 SELECT job_id, config_key, duration_seconds, node_id FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY duration_seconds, config_key) AS rn
  FROM fx_claims WHERE duration_seconds IS NOT NULL) WHERE rn = 1)"""

DURATION = (
    "CASE WHEN duration_seconds IS NULL THEN NULL WHEN floor(duration_seconds / 60) > 0 "
    "THEN CAST(floor(duration_seconds / 60) AS BIGINT) || 'm ' || printf('%.2fs', duration_seconds % 60) "
    "ELSE printf('%.2fs', duration_seconds % 60) END"
)

COSTS = "fx_costs(gpu_type, n_gpus, eur_per_hour) AS (VALUES {})".format(
    ", ".join(f"('{g}', {n}, CAST({p} AS DOUBLE))" for g, n, p in GPU_COSTS)
)

PARTS = """parts AS (
 SELECT job_id, config_key, duration_seconds, 'A40' AS gpu_type, a40 AS n_gpus FROM fx_claims WHERE a40 > 0
 UNION ALL SELECT job_id, config_key, duration_seconds, 'L40S', l40s FROM fx_claims WHERE l40s > 0)"""

STANDARD = f"""measured AS (SELECT * FROM fx_claims WHERE duration_seconds IS NOT NULL),
 {fits("std_fit", "measured")}, standard AS (
 SELECT job_id, config_key, node_id FROM (
  SELECT m.job_id, m.config_key, f.node_id,
   row_number() OVER (PARTITION BY m.job_id ORDER BY m.a40 + m.l40s, m.config_key) AS rn
  FROM measured m JOIN std_fit f ON f.config_key = m.config_key) WHERE rn = 1)"""

VALIDITY = f"""checked AS (
 SELECT *, NOT regexp_matches(image, '^[a-zA-Z0-9][a-zA-Z0-9._/:@-]*$') AS bad_image,
  coalesce(NOT priority BETWEEN 1 AND 5, false) AS bad_priority, coalesce(deadline < {NOW_SQL}, false) AS late,
  coalesce(epochs_total < 1, false) AS bad_epochs, coalesce(profiling_epochs_no < 1, false) AS bad_profiling FROM fx_jobs)"""

COMMANDS = """fx_commands AS (
 SELECT CASE WHEN user_id % 25 = 3 THEN 'ghost-' ELSE 'job-' END || user_id AS id, event_id AS seq,
  CASE WHEN event_type IN ('signup', 'purchase') THEN 'resume' WHEN event_id % 10 = 7 THEN 'pause' ELSE 'stop' END AS cmd FROM events),
 listed AS (SELECT id, list(cmd ORDER BY seq) AS cmds FROM fx_commands GROUP BY id),
 step AS (SELECT c.id, c.seq, c.cmd, j.status, l.cmds, row_number() OVER (PARTITION BY c.id ORDER BY c.seq) AS n
  FROM fx_commands c JOIN listed l ON l.id = c.id LEFT JOIN fx_jobs j ON j.id = c.id),
 state AS (SELECT id, seq, cmd, CASE WHEN status IS NOT NULL THEN list_reduce(list_prepend(status, cmds[1:n-1]),
   lambda s, c: CASE WHEN c = 'stop' AND s IN ('QUEUED', 'RUNNING', 'PROFILING') THEN 'PREEMPTED'
    WHEN c = 'resume' AND s IN ('PREEMPTED', 'FAILED') THEN 'QUEUED' ELSE s END) END AS status_before FROM step),
 outcomes AS (SELECT * REPLACE (CASE WHEN cmd <> 'pause' THEN status_before END AS status_before), CASE WHEN cmd = 'pause' THEN 'unknown_command'
   WHEN status_before IS NULL THEN 'not_found'
   WHEN cmd = 'stop' AND status_before = 'QUEUED' THEN 'stopped'
   WHEN cmd = 'stop' AND status_before IN ('RUNNING', 'PROFILING') THEN 'stop_requested'
   WHEN cmd = 'resume' AND status_before IN ('PREEMPTED', 'FAILED') THEN 'resume_requested' ELSE 'conflict' END AS outcome FROM state),
 commanded AS (SELECT *, CASE outcome WHEN 'unknown_command' THEN 400 WHEN 'not_found' THEN 404 WHEN 'conflict' THEN 409 ELSE 202 END AS code,
   CASE WHEN outcome IN ('unknown_command', 'not_found', 'conflict') THEN status_before WHEN cmd = 'stop' THEN 'PREEMPTED' ELSE 'QUEUED' END AS status_after
  FROM outcomes)"""

def plan(claims: str) -> str:
    return f"""WITH {FREE}, {claims}, {configs()}, {WAITING_TYPES}, {STANDARD}, {fits('p', 'fx_configs', 'f.is_for_profiling')},
    rem AS (
     SELECT t.job_id, c.config_key, p.node_id, row_number() OVER (PARTITION BY t.job_id ORDER BY c.n_gpus, c.config_key) - 1 AS pos
     FROM waiting_types t CROSS JOIN fx_configs c LEFT JOIN p ON p.config_key = c.config_key
     WHERE NOT EXISTS (SELECT 1 FROM fx_claims k WHERE k.job_id = t.job_id AND k.config_key = c.config_key)),
    stuck AS (SELECT job_id, min(pos) AS k FROM rem WHERE node_id IS NULL GROUP BY job_id),
    made AS (SELECT instance_id, count(*) AS n FROM fx_claims GROUP BY instance_id),
    w AS (SELECT j.id, j.job_id, coalesce(m.n, 0) < 1 AS open, row_number() OVER (
      PARTITION BY j.job_id, coalesce(m.n, 0) < 1 ORDER BY j.created_at, j.id) - 1 AS r
     FROM fx_jobs j LEFT JOIN made m ON m.instance_id = j.id WHERE {WAITING})
    SELECT w.id, w.job_id, CASE WHEN m.pos IS NOT NULL THEN 'profiling' ELSE 'standard' END AS mode,
     CASE WHEN m.pos IS NOT NULL THEN m.config_key ELSE s.config_key END AS config_key,
     CASE WHEN m.pos IS NOT NULL THEN m.node_id ELSE s.node_id END AS node_id, m.pos IS NOT NULL AS is_profiling_run
    FROM w LEFT JOIN stuck k ON k.job_id = w.job_id
    LEFT JOIN rem m ON w.open AND m.job_id = w.job_id AND m.pos = least(w.r, coalesce(k.k, w.r))
    LEFT JOIN standard s ON s.job_id = w.job_id"""


DASH = "'—'"

ORACLES: dict[str, str] = {
    "node_status": f"""WITH {NODES}, {JOBS}
        SELECT n.node_id, CASE WHEN n.is_for_profiling THEN 'Profiling' ELSE 'Compute' END AS role,
         CASE WHEN count(j.id) > 0 THEN 'busy' ELSE 'idle' END AS status, count(j.id) AS n_current_jobs
        FROM fx_nodes n LEFT JOIN fx_jobs j ON j.assigned_node = n.node_id AND {ACTIVE} GROUP BY 1, 2""",
    "node_current_jobs": f"""WITH {NODES}, {JOBS}
        SELECT n.node_id, CASE WHEN j.id IS NULL THEN 'idle' ELSE 'busy' END AS status, j.id AS current_job_id
        FROM fx_nodes n LEFT JOIN fx_jobs j ON j.assigned_node = n.node_id AND {ACTIVE}""",
    "node_job_ids": f"""WITH {NODES}, {JOBS}, p AS (SELECT assigned_node AS node_id, id,
          (row_number() OVER (PARTITION BY assigned_node ORDER BY id) - 1) // 5 AS page FROM fx_jobs WHERE {ACTIVE})
        SELECT n.node_id, coalesce(p.page, 0) AS page, CASE WHEN count(p.id) > 0 THEN 'busy' ELSE 'idle' END AS status,
         coalesce(string_agg(p.id, ',' ORDER BY p.id), '') AS current_job_ids
        FROM fx_nodes n LEFT JOIN p ON p.node_id = n.node_id GROUP BY 1, 2""",
    "node_counts": f"""WITH {NODES}, {JOBS}, s AS (
         SELECT n.node_id, EXISTS (SELECT 1 FROM fx_jobs WHERE assigned_node = n.node_id AND {ACTIVE}) AS busy FROM fx_nodes n)
        SELECT count(*) AS total, count(*) FILTER (WHERE busy) AS busy, count(*) FILTER (WHERE NOT busy) AS idle FROM s""",
    "gpu_usage": f"WITH {JOBS}, {USAGE} SELECT node_id, gpu_type, used FROM fx_usage",
    "remaining_capacity": f"""WITH {NODES}, {JOBS}, {USAGE}, total AS (
         SELECT node_id, 'A40' AS gpu_type, a40 AS total FROM fx_nodes WHERE a40 > 0
         UNION ALL SELECT node_id, 'L40S', l40s FROM fx_nodes WHERE l40s > 0)
        SELECT t.node_id, t.gpu_type, CAST(t.total AS BIGINT) AS total, coalesce(u.used, 0) AS used,
         CAST(t.total - coalesce(u.used, 0) AS BIGINT) AS free
        FROM total t LEFT JOIN fx_usage u ON u.node_id = t.node_id AND u.gpu_type = t.gpu_type""",
    "node_gpu_total": f"WITH {NODES} SELECT node_id, CAST(a40 + l40s AS INT) AS total_gpus FROM fx_nodes",
    "routing": f"""WITH {NODES}, {JOBS} SELECT j.id, j.assigned_node, n.worker_url AS target_url
        FROM fx_jobs j LEFT JOIN fx_nodes n ON n.node_id = j.assigned_node""",
    "valid_configs": f"WITH {NODES}, {configs()} SELECT config_key, n_gpus, {label()} AS label FROM fx_configs",
    "config_listing": f"WITH {NODES}, {configs()} SELECT n_gpus, config_key FROM fx_configs ORDER BY n_gpus, config_key",
    "configs_by_key": f"""WITH {NODES}, {configs()}
        SELECT config_key, n_gpus, CAST(row_number() OVER (ORDER BY config_key) AS INT) AS place FROM fx_configs""",
    "production_configs": f"WITH {NODES}, {configs('c', 'true')} SELECT config_key, n_gpus FROM c",
    "shared_configs": f"""WITH {NODES}, {configs('p')}, {configs('o', 'NOT n.is_for_profiling')}
        SELECT config_key, n_gpus FROM p INTERSECT SELECT config_key, n_gpus FROM o""",
    "restricted_configs": f"""WITH {NODES}, {configs('p')}, o AS (
         SELECT max(a40) AS most FROM fx_nodes WHERE NOT is_for_profiling)
        SELECT config_key, n_gpus FROM p, o WHERE l40s = 0 AND a40 <= most""",
    "unprofiled_configs": f"WITH {REM} SELECT job_id, n_gpus, config_key FROM rem",
    "next_config": f"WITH {REM} SELECT job_id, config_key, n_gpus FROM rem WHERE rn = 1",
    "profiled_configs": f"WITH {CLAIMS} SELECT DISTINCT job_id, config_key FROM fx_claims",
    "measured_configs": f"""WITH {CLAIMS} SELECT DISTINCT job_id, config_key FROM fx_claims
        WHERE duration_seconds IS NOT NULL""",
    "coverage": f"""WITH {NODES}, {JOBS}, {CLAIMS}, {configs()}, {TYPES}, n AS (SELECT count(*) AS valid FROM fx_configs), k AS (
         SELECT job_id, count(*) AS claimed, count(duration_seconds) AS completed FROM fx_claims GROUP BY job_id)
        SELECT t.job_id, coalesce(k.claimed, 0) AS claimed, coalesce(k.completed, 0) AS completed, n.valid,
         round(100.0 * coalesce(k.claimed, 0) / n.valid, 4)::DOUBLE AS claimed_pct,
         round(100.0 * coalesce(k.completed, 0) / n.valid, 4)::DOUBLE AS completed_pct
        FROM fx_types t LEFT JOIN k ON k.job_id = t.job_id, n""",
    "best_config": f"WITH {CLAIMS}, {BEST} SELECT job_id, config_key, duration_seconds, node_id FROM best",
    "config_grid": f"""WITH {NODES}, {JOBS}, {CLAIMS}, {configs()}, {TYPES}, {BEST}
        SELECT t.job_id, c.config_key, k.node_id, {DURATION.replace('duration_seconds', 'k.duration_seconds')} AS duration,
         CASE WHEN k.duration_seconds IS NOT NULL THEN 'done' ELSE 'pending' END AS status,
         coalesce(b.config_key = c.config_key, false) AS is_best
        FROM fx_types t CROSS JOIN fx_configs c LEFT JOIN fx_claims k ON k.job_id = t.job_id AND k.config_key = c.config_key
        LEFT JOIN best b ON b.job_id = t.job_id""",
    "durations": """WITH d AS (SELECT l_orderkey, l_linenumber,
          ((l_orderkey * 7 + l_linenumber * 1250 + l_partkey * 31) % 900000) / 10000.0::DOUBLE AS s FROM lineitem),
        r AS (SELECT *, floor(s / 60) AS m, s % 60 AS rest FROM d)
        SELECT l_orderkey, l_linenumber, CASE WHEN m > 0 THEN CAST(m AS BIGINT) || 'm ' ELSE '' END ||
         CASE WHEN rest * 8 = floor(rest * 8) AND CAST(rest * 8 AS BIGINT) % 2 = 1
          THEN printf('%.2fs', (floor(rest * 100) + 1) / 100) ELSE printf('%.2fs', rest) END AS duration FROM r""",
    "energy_cost": f"""WITH {CLAIMS}, {COSTS}, {PARTS}
        SELECT p.job_id, p.config_key, p.gpu_type, p.n_gpus, c.eur_per_hour
        FROM parts p LEFT JOIN fx_costs c ON c.gpu_type = p.gpu_type AND c.n_gpus = p.n_gpus""",
    "config_cost": f"""WITH {CLAIMS}, {COSTS}, {PARTS}
        SELECT p.job_id, p.config_key, p.duration_seconds,
         round(CASE WHEN count(c.eur_per_hour) = count(*) THEN sum(c.eur_per_hour) END, 6) AS eur_per_hour,
         round(CASE WHEN count(c.eur_per_hour) = count(*) THEN p.duration_seconds / 3600 * sum(c.eur_per_hour) END, 6) AS cost_eur
        FROM parts p LEFT JOIN fx_costs c ON c.gpu_type = p.gpu_type AND c.n_gpus = p.n_gpus
        WHERE p.duration_seconds IS NOT NULL GROUP BY 1, 2, 3""",
    "best_fit": f"""WITH {FREE}, w AS (SELECT id, a40, l40s, {key()} AS config_key FROM fx_jobs WHERE {WAITING}), {fits('f', 'w')}
        SELECT w.id, w.config_key, f.node_id, f.surplus FROM w LEFT JOIN f ON f.config_key = w.config_key""",
    "best_fit_large": f"""WITH {FREE}, w0 AS (SELECT 'job-' || o_orderkey AS id, CAST(1 + o_custkey % 7 AS INT) AS a40,
         CAST(o_orderkey % 4 AS INT) AS l40s FROM orders), w AS (SELECT *, {key()} AS config_key FROM w0), {fits('f', 'w')}
        SELECT w.id, w.config_key, f.node_id, f.surplus FROM w LEFT JOIN f ON f.config_key = w.config_key""",
    "best_fit_profiling": f"""WITH {FREE}, {configs()}, {fits('f', 'fx_configs', 'f.is_for_profiling')}
        SELECT c.config_key, f.node_id, f.surplus FROM fx_configs c LEFT JOIN f ON f.config_key = c.config_key""",
    "available_config": f"""WITH {FREE}, {CLAIMS}, {TYPES}, {STANDARD}
        SELECT t.job_id, s.config_key, s.node_id FROM fx_types t LEFT JOIN standard s ON s.job_id = t.job_id""",
    "results_by_duration": f"""WITH {CLAIMS} SELECT job_id, config_key, node_id, duration_seconds,
         CAST(row_number() OVER (PARTITION BY job_id ORDER BY duration_seconds NULLS LAST, config_key) AS INT) AS place FROM fx_claims""",
    "plan_round": plan(CLAIMS),
    "claims_after_plan": f"""WITH {CLAIMS}, planned AS ({plan(CLAIMS)})
        SELECT job_id, config_key, instance_id, node_id, duration_seconds, created_at FROM fx_claims
        UNION ALL SELECT job_id, config_key, id, node_id, NULL, {NOW_SQL} FROM planned WHERE is_profiling_run AND node_id IS NOT NULL""",
    "plan_standard": f"""WITH {FREE}, {CLAIMS}, {STANDARD}
        SELECT j.id, j.job_id, 'standard' AS mode, s.config_key, s.node_id, false AS is_profiling_run
        FROM fx_jobs j LEFT JOIN standard s ON s.job_id = j.job_id WHERE {WAITING}""",
    "claims_per_instance": f"""WITH {JOBS}, {CLAIMS} SELECT j.id, count(k.job_id) AS n_claims
        FROM fx_jobs j LEFT JOIN fx_claims k ON k.instance_id = j.id GROUP BY j.id""",
    "waiting_jobs": f"WITH {JOBS} SELECT id, job_id, created_at FROM fx_jobs WHERE {WAITING}",
    "active_jobs": f"WITH {JOBS} SELECT id, status, assigned_node, {key()} AS config_key FROM fx_jobs WHERE {ACTIVE}",
    "missed_queued": f"WITH {JOBS} SELECT id, created_at FROM fx_jobs WHERE status = 'QUEUED'",
    "get_job": f"WITH {JOBS} SELECT id, status, image FROM fx_jobs WHERE id = 'job-100'",
    "newest_page": f"""WITH {JOBS} SELECT id, status, created_at FROM fx_jobs
        ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""",
    "table_view": f"""WITH {JOBS} SELECT id, image, status FROM fx_jobs WHERE status ILIKE '%run%'
        ORDER BY image DESC, id LIMIT 15 OFFSET 30""",
    "status_counts": f"""WITH {JOBS} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'QUEUED') AS queued,
         count(*) FILTER (WHERE status = 'PROFILING') AS profiling, count(*) FILTER (WHERE status = 'RUNNING') AS running,
         count(*) FILTER (WHERE status IN ('SUCCEEDED', 'FAILED')) AS completed FROM fx_jobs""",
    "representative_jobs": f"""WITH {JOBS}, r AS (SELECT *, CASE status WHEN 'PROFILING' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'QUEUED' THEN 2
          WHEN 'PREEMPTED' THEN 3 WHEN 'FAILED' THEN 4 WHEN 'SUCCEEDED' THEN 5 ELSE 9 END AS rank FROM fx_jobs)
        SELECT job_id, id, status, created_at, rank FROM (
         SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY rank, created_at DESC, id) AS rn FROM r) WHERE rn = 1""",
    "search_status": f"WITH {JOBS} SELECT id, status FROM fx_jobs WHERE lower(status) LIKE '%ueu%'",
    "job_listing": f"""WITH {JOBS} SELECT id, substr(id, 1, 8) AS short_id, image, 'python3 main.py' AS command, status,
         {DASH} AS progress, priority, coalesce(CAST(epochs_total AS VARCHAR), {DASH}) AS epochs,
         coalesce(strftime(deadline, '%m/%d %H:%M'), {DASH}) AS deadline, coalesce(assigned_node, {DASH}) AS node,
         {label()} AS gpu_config, strftime(created_at, '%m/%d %H:%M') AS created,
         coalesce(CAST(exit_code AS VARCHAR), {DASH}) AS exit FROM fx_jobs""",
    "job_flags": f"""WITH {JOBS} SELECT id, status IN ('QUEUED', 'PROFILING', 'RUNNING') AS stoppable,
         status IN ('PREEMPTED', 'FAILED') AS resumable, status IN ('QUEUED', 'RUNNING') AS runnable,
         CASE status WHEN 'PROFILING' THEN 0 WHEN 'RUNNING' THEN 1 WHEN 'QUEUED' THEN 2
          WHEN 'PREEMPTED' THEN 3 WHEN 'FAILED' THEN 4 WHEN 'SUCCEEDED' THEN 5 ELSE 9 END AS rank,
         exit_code IS NULL AS first_run, 'run-' || substr(id, 1, 8) AS container FROM fx_jobs""",
    "run_env": f"""WITH {JOBS}, e AS (SELECT id, CASE WHEN status = 'PROFILING'
          THEN CAST(coalesce(nullif(profiling_epochs_no, 0), 3) AS VARCHAR) ELSE CAST(nullif(epochs_total, 0) AS VARCHAR) END AS epochs_total,
         CAST(nullif(batch_size, 0) AS VARCHAR) AS batch_size FROM fx_jobs)
        SELECT id, epochs_total, batch_size,
         CAST(3 + (epochs_total IS NOT NULL)::INT + (batch_size IS NOT NULL)::INT AS INT) AS n_settings FROM e""",
    "uuid_and_mask": r"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN replace(url, '://', '://user:pw@') ELSE url END AS url,
          CASE WHEN page_id % 3 = 0 THEN url ELSE substr(md5(url), 1, 8) || '-' || substr(md5(url), 9, 4) || '-' || substr(md5(url), 13, 4)
           || '-' || upper(substr(md5(url), 17, 4)) || '-' || substr(md5(url), 21, 12) END AS ref FROM pages)
        SELECT page_id, regexp_replace(url, '://[^@]+@', '://*****@', 'g') AS masked,
         regexp_matches(ref, '^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') AS is_uuid FROM p""",
    "validate_submissions": f"""WITH {JOBS}, {VALIDITY}
        SELECT id, NOT (bad_image OR bad_priority OR late OR bad_epochs OR bad_profiling) AS is_valid,
         concat_ws('; ', CASE WHEN bad_image THEN 'invalid image name' END, CASE WHEN bad_priority THEN 'priority out of range' END,
          CASE WHEN late THEN 'deadline in the past' END, CASE WHEN bad_epochs THEN 'epochs_total below 1' END,
          CASE WHEN bad_profiling THEN 'profiling_epochs_no below 1' END) AS errors FROM checked""",
    "normalise_submissions": f"""WITH {JOBS}, {VALIDITY}
        SELECT id, job_id, 'QUEUED' AS status, CASE WHEN script_path IS NOT NULL THEN 'python3 ' || script_path ELSE 'python3 main.py' END AS command,
         {NOW_SQL} AS created_at, coalesce(priority, 3) AS priority, coalesce(epochs_total, 20) AS epochs_total,
         coalesce(profiling_epochs_no, 3) AS profiling_epochs_no, false AS is_profiling_run
        FROM checked WHERE NOT (bad_image OR bad_priority OR late OR bad_epochs OR bad_profiling)""",
    "lifecycle_commands": f"""WITH {JOBS}, {COMMANDS}
        SELECT id, seq, status_before, status_after, outcome, code FROM commanded""",
    "commanded_jobs": f"""WITH {JOBS}, {COMMANDS}, last AS (
         SELECT id, arg_max(status_after, seq) AS status FROM commanded WHERE code = 202 GROUP BY id)
        SELECT j.id, coalesce(l.status, j.status) AS status,
         CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} ELSE j.created_at END AS updated_at
        FROM fx_jobs j LEFT JOIN last l ON l.id = j.id""",
    "run_outcomes": f"""WITH {JOBS}, e AS (
         SELECT 'job-' || o_orderkey AS id, CAST(o_custkey % 3 AS INT) AS code FROM orders WHERE o_orderkey % 10 <> 0),
        x AS (SELECT j.*, e.code, coalesce(e.code = 0 AND j.status = 'PROFILING', false) AS replan
         FROM fx_jobs j LEFT JOIN e ON e.id = j.id)
        SELECT id, CASE WHEN code IS NULL OR status = 'PREEMPTED' THEN status WHEN code <> 0 THEN 'FAILED'
          WHEN replan THEN 'QUEUED' ELSE 'SUCCEEDED' END AS status,
         CASE WHEN code IS NULL OR replan THEN exit_code ELSE code END AS exit_code,
         status = 'PROFILING' AND NOT replan AS is_profiling_run,
         CASE WHEN NOT replan THEN assigned_node END AS assigned_node, CASE WHEN NOT replan THEN {key()} END AS config_key,
         CASE WHEN code IS NULL THEN created_at ELSE {NOW_SQL} END AS updated_at, replan FROM x""",
    "orphaned_jobs": f"""WITH {JOBS}, live AS (SELECT 'run-' || substr('job-' || o_orderkey, 1, 8) AS name FROM orders WHERE o_orderkey % 3 = 0)
        SELECT id, 'run-' || substr(id, 1, 8) AS expected_container, status AS old_status, 'FAILED' AS status FROM fx_jobs
        WHERE status IN ('RUNNING', 'PROFILING') AND 'run-' || substr(id, 1, 8) NOT IN (SELECT name FROM live)""",
    "patch_jobs": f"""WITH {JOBS}, c AS (SELECT 'job-' || l_orderkey AS id,
          CASE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_linenumber || '/' || CAST(l_quantity AS INT) END AS progress,
          CAST(l_suppkey % 2 AS INT) AS exit_code, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn
         FROM lineitem)
        SELECT j.id, c.progress, CASE WHEN c.id IS NULL THEN j.exit_code ELSE c.exit_code END AS exit_code,
         CASE WHEN c.id IS NULL THEN j.created_at ELSE {NOW_SQL} END AS updated_at
        FROM fx_jobs j LEFT JOIN c ON c.id = j.id AND c.rn = 1""",
    "patch_unordered": f"""WITH {JOBS}, c AS (SELECT 'job-' || l_orderkey AS id, max(struct_pack(
          p := l_linenumber || '/9', e := CAST(l_suppkey % 2 AS INT))) AS v FROM lineitem GROUP BY l_orderkey)
        SELECT j.id, c.v.p AS progress, CASE WHEN c.id IS NULL THEN j.exit_code ELSE c.v.e END AS exit_code
        FROM fx_jobs j LEFT JOIN c ON c.id = j.id""",
    "delete_jobs": f"WITH {JOBS} SELECT id, status FROM fx_jobs WHERE status <> 'SUCCEEDED'",
    "delete_job_claims": f"""WITH {JOBS}, {CLAIMS} SELECT job_id, config_key, instance_id FROM fx_claims k
        WHERE NOT EXISTS (SELECT 1 FROM fx_jobs j WHERE j.id = k.instance_id AND j.status = 'SUCCEEDED')""",
    "clear_jobs": "SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM orders",
    "merge_claims": f"""WITH {CLAIMS}, n AS (SELECT *, {key()} AS config_key,
          row_number() OVER (PARTITION BY job_id, a40, l40s ORDER BY {FEED_ORDER}) AS rn FROM fx_feed)
        SELECT job_id, config_key, instance_id, node_id, duration_seconds, created_at FROM fx_claims
        UNION ALL SELECT job_id, config_key, instance_id, node_id, duration_seconds, created_at FROM n
        WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM fx_claims k WHERE k.job_id = n.job_id AND k.config_key = n.config_key)""",
    "complete_claims": f"""WITH {CLAIMS}, r AS (SELECT job_id, a40, l40s, node_id, l_quantity * 7 AS duration_seconds,
          row_number() OVER (PARTITION BY job_id, a40, l40s ORDER BY l_quantity, {FEED_ORDER}) AS rn
         FROM fx_feed WHERE duration_seconds IS NULL AND (l_partkey % 40 + a40 + l40s) % 3 <> 0)
        SELECT k.job_id, k.config_key, k.instance_id,
         CASE WHEN k.duration_seconds IS NULL AND r.job_id IS NOT NULL THEN r.node_id ELSE k.node_id END AS node_id,
         CASE WHEN k.duration_seconds IS NULL THEN r.duration_seconds ELSE k.duration_seconds END AS duration_seconds
        FROM fx_claims k LEFT JOIN r ON r.rn = 1 AND r.job_id = k.job_id AND r.a40 = k.a40 AND r.l40s = k.l40s""",
    "release_claims": f"""WITH {JOBS}, {CLAIMS} SELECT job_id, config_key, duration_seconds FROM fx_claims k
        WHERE NOT (k.duration_seconds IS NULL AND EXISTS (SELECT 1 FROM fx_jobs j
         WHERE j.status = 'FAILED' AND j.job_id = k.job_id AND j.a40 = k.a40 AND j.l40s = k.l40s))""",
    "stored_jobs": f"""WITH {JOBS} SELECT id, job_id, status, coalesce(priority, 3) AS priority, coalesce(epochs_total, 20) AS epochs_total,
         coalesce(profiling_epochs_no, 3) AS profiling_epochs_no, {key()} AS config_key FROM fx_jobs""",
    "stored_claims": f"WITH {CLAIMS} SELECT job_id, config_key, node_id, duration_seconds FROM fx_claims",
    "stored_inventory": f"""WITH {NODES} SELECT node_id, row_number() OVER (ORDER BY node_pos) - 1 AS node_pos, is_for_profiling,
         round(cost, 6) AS cost, worker_url, CAST(a40 + l40s AS INT) AS total_gpus FROM fx_nodes""",
    "priced_configs": f"""WITH {CLAIMS}, {COSTS}, {PARTS}
        SELECT p.job_id, p.config_key, p.duration_seconds,
         round(CASE WHEN count(c.eur_per_hour) = count(*) THEN sum(c.eur_per_hour) END, 6) AS eur_per_hour,
         round(CASE WHEN count(c.eur_per_hour) = count(*) THEN p.duration_seconds / 3600 * sum(c.eur_per_hour) END, 6) AS cost_eur
        FROM parts p LEFT JOIN fx_costs c ON c.gpu_type = p.gpu_type AND c.n_gpus = p.n_gpus
        WHERE p.duration_seconds IS NOT NULL GROUP BY 1, 2, 3""",
    "stored_submissions": """WITH p AS (SELECT o_orderkey % 60 AS k, 'type-' || (o_custkey % 40) AS t FROM orders),
        c AS (SELECT CASE WHEN k NOT IN (1, 16) THEN t END AS job_id,
         CASE WHEN k IN (2, 16) THEN NULL WHEN k = 3 THEN '../evil' ELSE 'img:v1' END AS image,
         CASE WHEN k IN (6, 7, 9, 16) THEN NULL WHEN k = 4 THEN 0 WHEN k = 5 THEN 6 WHEN k = 8 THEN 4 ELSE 3 END AS priority,
         CASE k WHEN 1 THEN 'job_id is required' WHEN 2 THEN 'image is required' WHEN 3 THEN 'invalid image name'
          WHEN 4 THEN 'priority out of range' WHEN 5 THEN 'priority out of range' WHEN 6 THEN 'priority has the wrong type'
          WHEN 7 THEN 'priority has the wrong type' WHEN 10 THEN 'deadline has the wrong type' WHEN 11 THEN 'deadline in the past'
          WHEN 13 THEN 'epochs_total below 1' WHEN 14 THEN 'epochs_total has the wrong type'
          WHEN 15 THEN 'command has the wrong type' WHEN 16 THEN 'not a JSON object' ELSE '' END AS errors,
         CASE WHEN k NOT IN (15, 16) THEN 2 END AS n FROM p)
        SELECT job_id, image, CAST(priority AS INT) AS priority, errors = '' AS is_valid, errors, count(*) AS n,
         CAST(sum(n) AS BIGINT) AS n_words FROM c GROUP BY 1, 2, 3, 4, 5""",
    "stored_run_logs": f"""WITH {STORED_LOG} SELECT job_id, line_no, line FROM l
        WHERE job_id IN (SELECT job_id FROM l WHERE line_no = 1 AND event_id % 2 = 0)""",
    "guarded_run_logs": f"""WITH {STORED_LOG}, s AS (SELECT job_id, count(*) AS n, sum(strlen(line) + 1) AS bytes FROM l GROUP BY job_id)
        SELECT job_id, CASE WHEN bytes <= 600 THEN n ELSE 0 END AS n_lines, bytes <= 600 AS is_kept FROM s""",
    "parse_progress": rf"""WITH {LOG} SELECT event_id,
         CAST(nullif(regexp_extract(line, 'Epoch\s+(\d+)/(\d+)', 1), '') AS BIGINT) AS epoch,
         CAST(nullif(regexp_extract(line, 'Epoch\s+(\d+)/(\d+)', 2), '') AS BIGINT) AS total FROM fx_log""",
    "epoch_lines": rf"""WITH {LOG} SELECT event_id, CAST(regexp_extract(line, 'Epoch (\d+)/', 1) AS BIGINT) AS epoch,
         CAST(regexp_extract(line, 'Epoch \d+/(\d+)', 1) AS BIGINT) AS total,
         CAST(regexp_extract(line, 'Loss: ([0-9.]+)', 1) AS DOUBLE) AS loss,
         CAST(regexp_extract(line, 'Acc: ([0-9.]+)%', 1) AS DOUBLE) AS accuracy,
         CAST(regexp_extract(line, '([0-9.]+)s$', 1) AS DOUBLE) AS seconds, CAST(substr(line, 1, 19) AS TIMESTAMP) AS logged_at
        FROM fx_log WHERE line LIKE '%Epoch %'""",
    "latest_progress": f"""WITH {MARKS} SELECT run_id, epoch || '/' || total AS progress FROM (
         SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, line_no DESC) AS rn FROM marks) WHERE rn = 1""",
    "epoch_intervals": f"""WITH {MARKS}, s AS (SELECT *, lag(ts) OVER w AS before, row_number() OVER w AS n FROM marks
         WINDOW w AS (PARTITION BY run_id ORDER BY ts, line_no))
        SELECT run_id, line_no, epoch, round((epoch_us(ts) - epoch_us(before)) / 1e6, 3) AS interval_seconds, n = 2 AS is_warmup
        FROM s WHERE n > 1""",
    "run_duration": f"""WITH {MARKS}, {RUNS}, s AS (SELECT *, lag(ts) OVER w AS before, row_number() OVER w AS n FROM marks
         WINDOW w AS (PARTITION BY run_id ORDER BY ts, line_no)), d AS (
         SELECT run_id, count(*) AS n_marks, avg((epoch_us(ts) - epoch_us(before)) / 1e6) FILTER (WHERE n > 2) AS mean,
          arg_max(epoch, n) AS last FROM s GROUP BY run_id)
        SELECT r.run_id, coalesce(d.n_marks, 0) AS n_marks, round(CASE WHEN d.n_marks >= 3 THEN d.mean * d.last
          ELSE (epoch_us(r.ended_at) - epoch_us(r.started_at)) / 1e6 END, 2) AS duration_seconds
        FROM fx_runs r LEFT JOIN d ON d.run_id = r.run_id""",
    "best_so_far": rf"""WITH {MARKS}, m AS (SELECT k.*, CAST(regexp_extract(l.line, 'Acc: ([0-9.]+)%', 1) AS DOUBLE) AS accuracy
         FROM marks k JOIN fx_log l ON l.event_id = k.line_no)
        SELECT run_id, line_no, epoch, accuracy, max(accuracy) OVER (PARTITION BY run_id ORDER BY ts, line_no
         ROWS UNBOUNDED PRECEDING) AS best_accuracy FROM m""",
    "attempts": """SELECT event_id, 'job-' || user_id AS run_id, CAST(sum((event_type = 'error')::INT) OVER (
         PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM events""",
    "attempt_progress": f"""WITH {MARKS}, a AS (SELECT event_id, 'job-' || user_id AS run_id, CAST(sum((event_type = 'error')::INT) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempt FROM events)
        SELECT a.run_id, a.attempt, count(*) AS n_lines, arg_max(m.epoch, (m.ts, m.line_no)) FILTER (WHERE m.epoch IS NOT NULL) AS epoch,
         arg_max(m.total, (m.ts, m.line_no)) FILTER (WHERE m.epoch IS NOT NULL) AS total
        FROM a LEFT JOIN marks m ON m.line_no = a.event_id GROUP BY a.run_id, a.attempt""",
    "epoch_loss": f"""WITH {RUNS}, b AS (SELECT 'job-' || user_id AS run_id, 1 + event_id % 8 AS epoch, CAST(value AS DECIMAL(12,2)) AS loss
         FROM events WHERE event_type <> 'error'), s AS (SELECT run_id, epoch, sum(loss) AS total, count(*) AS n FROM b GROUP BY 1, 2)
        SELECT r.run_id, e.x AS epoch, coalesce(s.n, 0) AS n_batches,
         round(CAST(coalesce(s.total, 0) AS DOUBLE) / greatest(coalesce(s.n, 0), 1), 6) AS loss
        FROM fx_runs r CROSS JOIN generate_series(1, 8) e(x) LEFT JOIN s ON s.run_id = r.run_id AND s.epoch = e.x""",
    "accuracy": """SELECT count(*) AS n, round(100.0 * sum(((list_position(embedding, list_max(embedding)) - 1) % 10 = label)::INT)
         / count(*), 6)::DOUBLE AS accuracy FROM embeddings""",
    "accuracy_by_label": """SELECT label, count(*) AS n, round(100.0 * sum(((list_position(embedding, list_max(embedding)) - 1) % 10 = label)::INT)
         / count(*), 6)::DOUBLE AS accuracy FROM embeddings GROUP BY label""",
    "timeouts": f"""WITH {RUNS}, e AS (SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS elapsed FROM fx_runs)
        SELECT run_id, started_at, ended_at, round(elapsed, 3) AS elapsed_seconds FROM e WHERE elapsed > 29 * 24 * 3600""",
    "stream_epoch_lines": """SELECT 'job-' || user_id AS run_id, event_id AS line_no, 1 + event_id % 500 AS epoch,
         CAST(500 AS BIGINT) AS total FROM events WHERE event_type <> 'error'""",
    "stream_latest_progress": """SELECT 'job-' || user_id AS run_id, arg_max(1 + event_id % 500, (ts, event_id)) || '/500' AS progress
        FROM events WHERE event_type <> 'error' GROUP BY user_id""",
    "stream_run_duration": """WITH m AS (SELECT 'job-' || user_id AS run_id, ts, event_id, 1 + event_id % 500 AS epoch,
          row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
        d AS (SELECT run_id, count(*) AS n_marks, (epoch_us(max(ts)) - epoch_us(min(ts) FILTER (WHERE n = 2))) / 1e6 AS span,
          arg_max(epoch, n) AS last FROM m GROUP BY run_id),
        e AS (SELECT 'job-' || c_custkey AS run_id, (1 + c_custkey % 20) * 3600.0 AS wall FROM customer WHERE c_custkey % 5 <> 0)
        SELECT coalesce(e.run_id, d.run_id) AS run_id, CASE WHEN e.run_id IS NULL THEN 'timeout' ELSE 'ended' END AS outcome,
         coalesce(d.n_marks, 0) AS n_marks,
         round(CASE WHEN d.n_marks >= 3 THEN d.span / (d.n_marks - 2) * d.last ELSE e.wall END, 2)::DOUBLE AS duration_seconds
        FROM e FULL JOIN d ON d.run_id = e.run_id""",
    "stream_status_counts": f"""WITH {JOBS}, c AS (SELECT 'job-' || user_id AS id, arg_max(CASE event_type WHEN 'error' THEN 'FAILED'
          WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'click' THEN 'RUNNING' ELSE 'QUEUED' END, (ts, event_id)) AS status FROM events GROUP BY user_id),
        j AS (SELECT coalesce(c.status, f.status) AS status FROM fx_jobs f LEFT JOIN c ON c.id = f.id)
        SELECT count(*) AS total, count(*) FILTER (WHERE status = 'QUEUED') AS queued,
         count(*) FILTER (WHERE status = 'PROFILING') AS profiling, count(*) FILTER (WHERE status = 'RUNNING') AS running,
         count(*) FILTER (WHERE status IN ('SUCCEEDED', 'FAILED')) AS completed FROM j""",
    "stream_dispatches": """SELECT DISTINCT 'job-' || l_orderkey AS id, l_linenumber % 2 AS attempt FROM lineitem""",
    "stream_replan": plan(f"""{CLAIMS.replace("fx_claims AS", "old_claims AS")}, r AS (
         SELECT job_id, a40, l40s, node_id, l_quantity * 7 AS duration_seconds,
          row_number() OVER (PARTITION BY job_id, a40, l40s ORDER BY l_quantity, {FEED_ORDER}) AS rn FROM fx_feed WHERE duration_seconds IS NULL),
        fx_claims AS (SELECT k.job_id, k.a40, k.l40s, k.config_key, k.instance_id, k.created_at,
          CASE WHEN k.duration_seconds IS NULL AND r.job_id IS NOT NULL THEN r.node_id ELSE k.node_id END AS node_id,
          coalesce(k.duration_seconds, r.duration_seconds) AS duration_seconds
         FROM old_claims k LEFT JOIN r ON r.rn = 1 AND r.job_id = k.job_id AND r.a40 = k.a40 AND r.l40s = k.l40s)"""),
    "restart_recovery": f"""WITH {JOBS}, live AS (SELECT 'run-' || substr('job-' || o_orderkey, 1, 8) AS name FROM orders WHERE o_orderkey % 3 = 0)
        SELECT id, 'fail' AS action FROM fx_jobs
        WHERE status IN ('RUNNING', 'PROFILING') AND 'run-' || substr(id, 1, 8) NOT IN (SELECT name FROM live)
        UNION ALL SELECT id, 'dispatch' FROM fx_jobs WHERE status = 'QUEUED'""",
}

_VERSIONS = """b AS (SELECT 'job-' || o_orderkey AS id, o_orderstatus AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority, o_orderkey AS n FROM orders),
a AS (SELECT id, CASE WHEN n % 5 = 2 THEN 'X' ELSE status END AS status, CASE WHEN n % 13 <> 4 THEN priority END AS priority
 FROM b, range(0, 2) r(k) WHERE n % 11 <> 7 AND (k = 0 OR n % 17 = 3)),
diff AS (SELECT change, count(*) AS copies, id, status, priority FROM (
 SELECT 'removed' AS change, * FROM (SELECT id, status, priority FROM b EXCEPT ALL SELECT id, status, priority FROM a)
 UNION ALL SELECT 'added', * FROM (SELECT id, status, priority FROM a EXCEPT ALL SELECT id, status, priority FROM b)) GROUP BY ALL)"""

_RUNS_ON_NODES = """r AS (SELECT 'node-' || l_suppkey AS node_id, l_shipdate AS s, l_shipdate + to_days(CAST(l_quantity AS INT)) AS e,
 CAST(l_linenumber % 5 AS INT) AS a40, CAST(l_suppkey % 3 AS INT) AS l40s FROM lineitem)"""

_SESSIONS = """g AS (SELECT 'job-' || user_id AS run_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new
 FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(new) OVER (PARTITION BY run_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g),
sessions AS (SELECT run_id, min(ts) AS session_start, max(ts) AS last_line, count(*) AS n_lines FROM k GROUP BY run_id, k)"""

ORACLES |= {
    "log_line_status": """WITH c AS (SELECT 'job-' || user_id AS run_id, ts, arg_max(CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCEEDED'
  WHEN 'click' THEN 'RUNNING' ELSE 'QUEUED' END, event_id) AS status FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT l.run_id, event_id AS line_no, status FROM (SELECT 'job-' || user_id AS run_id, ts, event_id FROM events) l
ASOF LEFT JOIN c ON l.run_id = c.run_id AND l.ts >= c.ts""",
    "runs_in_downtime": f"""WITH {_RUNS_ON_NODES}, d AS (SELECT 'node-' || (o_custkey % 100) AS node_id, o_orderkey AS downtime, o_orderdate AS s,
  o_orderdate + to_days(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 200 ELSE o_orderkey % 9 END AS INT)) AS e FROM orders WHERE o_orderkey % 20 = 0)
SELECT r.node_id, downtime, count(*) AS n_runs, sum((epoch(least(r.e, d.e)) - epoch(greatest(r.s, d.s))) / 3600) AS hours
FROM r JOIN d ON r.node_id = d.node_id AND r.s < d.e AND d.s < r.e WHERE r.s < r.e AND d.s < d.e GROUP BY ALL""",
    "peak_gpus": f"""WITH {_RUNS_ON_NODES}, t AS (SELECT node_id, 'A40' AS gpu_type, a40 AS n, s, e FROM r UNION ALL SELECT node_id, 'L40S', l40s, s, e FROM r),
c AS (SELECT node_id, gpu_type, moment, sum(n) AS n FROM (SELECT node_id, gpu_type, s AS moment, n FROM t WHERE n > 0 AND s < e
  UNION ALL SELECT node_id, gpu_type, e, -n FROM t WHERE n > 0 AND s < e) GROUP BY ALL),
u AS (SELECT *, CAST(sum(n) OVER (PARTITION BY node_id, gpu_type ORDER BY moment) AS BIGINT) AS used FROM c)
SELECT node_id, gpu_type, max(used) AS peak, arg_min(moment, (-used, moment)) AS peak_at FROM u GROUP BY ALL""",
    "log_sessions": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "stream_log_sessions": f"WITH {_SESSIONS} SELECT * FROM sessions",
    "stalled_runs": f"""WITH {_SESSIONS}, p AS (SELECT run_id, lag(last_line) OVER w AS stalled_from, session_start AS stalled_to, row_number() OVER w - 1 AS n_stall
 FROM sessions WINDOW w AS (PARTITION BY run_id ORDER BY session_start)) SELECT * FROM p WHERE n_stall > 0""",
    "usage_rollup": f"""WITH {JOBS}, e AS (SELECT assigned_node, 'A40' AS gpu_type, a40 AS n, status FROM fx_jobs UNION ALL SELECT assigned_node, 'L40S', l40s, status FROM fx_jobs)
SELECT assigned_node, gpu_type, status, CAST(grouping(assigned_node, gpu_type, status) AS INT) AS level, CAST(sum(n) AS BIGINT) AS gpus, count(*) AS assignments
FROM e WHERE n > 0 AND assigned_node IS NOT NULL
GROUP BY GROUPING SETS ((assigned_node, gpu_type, status), (assigned_node, gpu_type), (assigned_node), (gpu_type, status), (gpu_type), (status), ())""",
    "job_table_diff": f"WITH {_VERSIONS} SELECT * FROM diff",
    "job_column_changes": f"""WITH {_VERSIONS}, one AS (SELECT id FROM diff GROUP BY id HAVING coalesce(sum(copies) FILTER (WHERE change = 'removed'), 0) = 1
  AND coalesce(sum(copies) FILTER (WHERE change = 'added'), 0) = 1),
p AS (SELECT id, x.status AS s1, y.status AS s2, x.priority AS p1, y.priority AS p2 FROM one JOIN diff x USING (id) JOIN diff y USING (id)
 WHERE x.change = 'removed' AND y.change = 'added')
SELECT id, 'status' AS field, s1 AS before, s2 AS after FROM p WHERE s1 IS DISTINCT FROM s2
UNION ALL SELECT id, 'priority', CAST(p1 AS VARCHAR), CAST(p2 AS VARCHAR) FROM p WHERE p1 IS DISTINCT FROM p2""",
}

ORACLES |= {
    "rolling_values": """SELECT 'job-' || user_id AS run_id, event_id, count(*) OVER w AS n_before, avg(value) OVER w AS mean, max(value) OVER w AS most
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)""",
    "value_sketches": """SELECT event_type, count(*) AS n_merged, count(DISTINCT user_id) AS n_runs, true AS quantile_within, true AS count_within
FROM events GROUP BY event_type""",
    "value_quantiles": "SELECT event_type, quantile_cont(value, 0.95) AS quantile_value, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY event_type",
}

ORACLES |= {"log_table_lines": ORACLES["stored_run_logs"], "log_table_guard": ORACLES["guarded_run_logs"]}
