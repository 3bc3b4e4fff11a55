"""The set form of the placement plan against a job-by-job walk."""

import random
from datetime import timedelta

import pytest
from helpers import NOW, claims, jobs, nodes

from runlens.plans.placement import plan_round

TYPES = ["A", "B"]


def key(config):
    return "{" + ",".join(f'"{t}":{n}' for t, n in sorted(config.items())) + "}"


def products(gpus):
    found = [{}]
    for gpu, count in gpus.items():
        found = [{**c, **({gpu: n} if n else {})} for c in found for n in range(count + 1)]
    return [c for c in found if c]


def walk(job_rows, claim_rows, node_rows, limit):
    """Oldest first; a claim made for one job is seen by the next."""
    used = {}
    for j in job_rows:
        if j["status"] in ("RUNNING", "PROFILING") and j.get("assigned_node"):
            for gpu, n in (j.get("assigned_gpu_config") or {}).items():
                used[j["assigned_node"], gpu] = used.get((j["assigned_node"], gpu), 0) + n

    def place(config, profiling_only):
        best = None
        for pos, (name, prof, gpus) in enumerate(node_rows):
            left = {g: n - used.get((name, g), 0) for g, n in gpus.items()}
            if (prof or not profiling_only) and all(left.get(g, 0) >= n for g, n in config.items()):
                surplus = sum(left[g] - n for g, n in config.items())
                if best is None or (surplus, pos) < best[:2]:
                    best = (surplus, pos, name)
        return best and best[2]

    valid = {key(c): c for _, prof, gpus in node_rows if prof for c in products(gpus)}
    order = sorted(valid.values(), key=lambda c: (sum(c.values()), key(c)))
    held = [(t, key(c), inst) for t, c, _, inst in claim_rows]
    measured = {}
    for t, c, duration, _ in claim_rows:
        if duration is not None:
            measured.setdefault(t, {})[key(c)] = c
    plan = {}
    waiting = [j for j in job_rows if j["status"] == "QUEUED" and not j.get("assigned_node")]
    for j in sorted(waiting, key=lambda j: (j["created_at"], j["id"])):
        taken = {k for t, k, _ in held if t == j["job_id"]}
        rest = [c for c in order if key(c) not in taken]
        if rest and sum(inst == j["id"] for _, _, inst in held) < limit:
            node = place(rest[0], True)
            plan[j["id"]] = ("profiling", key(rest[0]), node)
            if node:
                held.append((j["job_id"], key(rest[0]), j["id"]))
        else:
            plan[j["id"]] = ("standard", None, None)
            for c in sorted(measured.get(j["job_id"], {}).values(), key=lambda c: (sum(c.values()), key(c))):
                if node := place(c, False):
                    plan[j["id"]] = ("standard", key(c), node)
                    break
    return plan


def case(seed):
    rng = random.Random(seed)
    node_rows = [
        (f"n{i}", rng.random() < 0.5, {t: rng.randint(1, 3) for t in TYPES if rng.random() < 0.7})
        for i in range(rng.randint(1, 4))
    ]
    everything = [c for _, _, gpus in node_rows for c in products(gpus)] or [{"A": 1}]
    job_rows = []
    for i in range(rng.randint(1, 14)):
        row = {
            "id": f"j{i:02}",
            "job_id": f"t{rng.randrange(3)}",
            "status": rng.choice(["QUEUED"] * 4 + ["RUNNING", "PROFILING"]),
            "created_at": NOW + timedelta(days=rng.randrange(3)),
        }
        if row["status"] != "QUEUED":
            row["assigned_node"] = rng.choice([*[n[0] for n in node_rows], "gone", None])
            row["assigned_gpu_config"] = rng.choice([*everything, None])
        job_rows.append(row)
    claim_rows, seen = [], set()
    for _ in range(rng.randrange(8)):
        t, c = f"t{rng.randrange(3)}", rng.choice(everything)
        if (t, key(c)) not in seen:
            seen.add((t, key(c)))
            claim_rows.append((t, c, rng.choice([None, 1.0, 2.0]), f"j{rng.randrange(14):02}"))
    return job_rows, claim_rows, node_rows, rng.choice([1, 1, 2])


@pytest.mark.parametrize("seed", range(20))
def test_plan_equals_the_walk(spark, seed):
    job_rows, claim_rows, node_rows, limit = case(seed)
    expected = walk(job_rows, claim_rows, node_rows, limit)
    planned = plan_round(jobs(spark, *job_rows), claims(spark, *claim_rows), nodes(spark, *node_rows), limit).collect()
    assert {r["id"]: (r["mode"], r["config_key"], r["node_id"]) for r in planned} == expected
    assert all(r["is_profiling_run"] == (r["mode"] == "profiling") for r in planned)
