"""GPU configurations: which exist, which were profiled, which node fits one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.functions import config_key, config_total
from runlens.plans.ordered import join_unique
from runlens.schemas import GPU_CONFIG


def enumerate_configs(nodes: DataFrame, profiling_only: bool = False) -> DataFrame:
    """C-01. Distinct non-empty configurations (gpu_config, config_key, n_gpus) the nodes can run.

    Nodes are reduced to their distinct layouts first, so the product is made once per layout
    and not once per node. A configuration is a number in the mixed radix given by the layout's
    counts; decoding the numbers builds no intermediate products.
    """
    if profiling_only:
        nodes = nodes.where("is_for_profiling")
    layouts = nodes.select(
        F.sort_array(F.filter("resources", lambda r: r["gpu_count"] > 0)).alias("layout")
    ).where(F.size("layout") > 0)
    one = F.array(F.lit(1).cast("bigint"))
    steps = F.aggregate(
        "layout", one, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) * (r["gpu_count"] + 1)))
    )
    codes = (
        layouts.distinct()
        .withColumn("steps", steps)
        .select("layout", "steps", F.explode(F.sequence(F.lit(1), F.element_at("steps", -1) - 1)).alias("code"))
    )

    def count(r: Column, i: Column) -> Column:
        return F.call_function("div", F.col("code"), F.get("steps", i)) % (r["gpu_count"] + 1)

    parts = F.transform("layout", lambda r, i: F.struct(r["gpu_type"], count(r, i).cast("int").alias("n")))
    return _keyed(codes.select(F.filter(parts, lambda p: p["n"] > 0).alias("parts")).distinct())


def _keyed(parts: DataFrame) -> DataFrame:
    """Configurations from their sorted entries. Arrays, unlike maps, can be grouped."""
    configs = parts.select(F.map_from_entries("parts").alias("gpu_config"))
    return configs.withColumns({"config_key": config_key("gpu_config"), "n_gpus": config_total("gpu_config")})


def distinct_configs(df: DataFrame) -> DataFrame:
    """The distinct ``gpu_config`` values, with ``config_key`` and ``n_gpus``."""
    wanted = df.where(F.col("gpu_config").isNotNull())
    return _keyed(wanted.select(F.sort_array(F.map_entries("gpu_config")).alias("parts")).distinct())


def valid_configs(nodes: DataFrame, production: str = "all") -> DataFrame:
    """C-02. Configurations worth profiling: those of profiling nodes that production can run.

    With ``production="all"`` every node counts as production, profiling nodes too, so the
    intersection is the configurations of the profiling nodes. ``"non_profiling"`` leaves
    profiling nodes out of production.
    """
    profiling = enumerate_configs(nodes, profiling_only=True)
    if production == "all":
        return profiling
    if production != "non_profiling":
        raise ValueError("production must be 'all' or 'non_profiling'")
    others = enumerate_configs(nodes.where(~F.col("is_for_profiling")))
    return profiling.join(others.select("config_key"), "config_key", "left_semi")


def fitting_configs(configs: DataFrame, node_free: DataFrame, profiling_only: bool = False) -> DataFrame:
    """(config_key, n_gpus, surplus, node_pos, node_id) for those of the distinct ``configs`` that
    fit on some node, with the node they fit best.

    A node fits when it has enough of every required type. The tightest fit wins, then the
    node listed first. Nodes with the same free GPUs compete only by their place, so they are
    first reduced to the earliest node per distinct free layout. What meets in the join is
    layouts and configurations, whose number depends on the hardware and not on how many nodes
    or jobs there are.
    """
    if profiling_only:
        node_free = node_free.where("is_for_profiling")
    free = F.sort_array(
        F.transform(F.filter("capacity", lambda c: c["free"] > 0), lambda c: F.struct(c["gpu_type"], c["free"]))
    )
    layouts = (
        node_free.select("node_id", "node_pos", free.alias("layout"))
        .where(F.size("layout") > 0)
        .groupBy("layout")
        .agg(F.min(F.struct("node_pos", "node_id")).alias("node"))
    )
    offered = layouts.select("node", F.inline("layout"))
    needed = configs.select(
        "config_key",
        "n_gpus",
        F.size("gpu_config").alias("n_types"),
        F.explode("gpu_config").alias("gpu_type", "needed"),
    )
    return (
        needed.join(offered, (needed["gpu_type"] == offered["gpu_type"]) & (offered["free"] >= needed["needed"]))
        .groupBy("config_key", "n_gpus", "n_types", "node")
        .agg(F.count(F.lit(1)).alias("n_met"), F.sum(F.col("free") - F.col("needed")).alias("surplus"))
        .where(F.col("n_met") == F.col("n_types"))
        .groupBy("config_key", "n_gpus")
        .agg(F.min(F.struct("surplus", "node.node_pos", "node.node_id")).alias("fit"))
        .select("config_key", "n_gpus", "fit.*")
    )


def best_fit(configs: DataFrame, node_free: DataFrame, profiling_only: bool = False) -> DataFrame:
    """J-03. (config_key, node_id, surplus) per distinct configuration; NULL node if none fits."""
    distinct = distinct_configs(configs)
    fits = fitting_configs(distinct, node_free, profiling_only)
    return distinct.select("config_key").join(fits, "config_key", "left").select("config_key", "node_id", "surplus")


def fit_requests(requests: DataFrame, node_free: DataFrame, profiling_only: bool = False) -> DataFrame:
    """J-03 for rows with a ``gpu_config`` and ``config_key``: add ``node_id`` and ``surplus``."""
    return join_unique(requests, best_fit(requests, node_free, profiling_only), ["config_key"])


def profiled_configs(claims: DataFrame, completed_only: bool = False) -> DataFrame:
    """A-05. Distinct configurations claimed per job type, or only those measured."""
    if completed_only:
        claims = claims.where(F.col("duration_seconds").isNotNull())
    keys = claims.select("job_id", "config_key").distinct()
    return keys.withColumn("gpu_config", F.from_json("config_key", GPU_CONFIG))


def rank_configs(configs: DataFrame) -> DataFrame:
    """Add ``place``, from 0, in the order configurations are profiled: fewest GPUs, then key.

    Each GPU count is ranked by itself, and moved up by the configurations of smaller counts.
    """
    sizes = configs.groupBy("n_gpus").agg(F.count(F.lit(1)).alias("_n"))
    # One row per GPU count of the hardware.
    smaller = Window.orderBy("n_gpus").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("n_gpus", F.coalesce(F.sum("_n").over(smaller), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("n_gpus").orderBy("config_key"))
    ranked = configs.withColumn("_own", own).join(sizes, "n_gpus")
    return ranked.withColumn("place", F.col("_first") + F.col("_own") - 1).drop("_own", "_first")


def claimed_places(claims: DataFrame, ranked: DataFrame) -> DataFrame:
    """(job_id, place) of the valid configurations each type has a claim for."""
    held = claims.select("job_id", "config_key").distinct()
    return held.join(ranked.select("config_key", "place"), "config_key").select("job_id", "place")


def open_gaps(types: DataFrame, ranked: DataFrame, held: DataFrame) -> DataFrame:
    """(job_id, first, next, open_before) for each run of places of a type that nobody claimed.

    Only what is claimed is sorted: between two claimed places lies a gap from ``first`` up to and without ``next``,
    and ``open_before`` open places come before it. So the r-th open configuration of a type is found by its
    gap, and no type ever holds the list of all configurations.
    """
    total = ranked.agg(F.count(F.lit(1))).scalar()
    by_place = Window.partitionBy("job_id").orderBy("place")
    after = held.select(
        "job_id",
        (F.col("place") + 1).alias("first"),
        F.coalesce(F.lead("place").over(by_place), total).alias("next"),
        (F.col("place") + 1 - F.row_number().over(by_place)).alias("open_before"),
    )
    least = held.groupBy("job_id").agg(F.min("place").alias("_least"))
    zero = F.lit(0).cast("bigint")
    wanted = types.select("job_id").distinct()
    before = wanted.join(least, "job_id", "left").select(
        "job_id", zero.alias("first"), F.coalesce("_least", total).alias("next"), zero.alias("open_before")
    )
    return before.unionByName(after.join(wanted, "job_id", "left_semi")).where("next > first")


def open_places(gaps: DataFrame) -> DataFrame:
    """(job_id, r, place): the r-th open place, from 0, of every gap. A column ``most`` bounds r per row."""
    last = F.col("next") - 1
    if "most" in gaps.columns:
        gaps = gaps.where("open_before < most")
        last = F.least(last, F.col("first") + F.col("most") - F.col("open_before") - 1)
    places = gaps.select("job_id", "first", "open_before", F.explode(F.sequence("first", last)).alias("place"))
    return places.select("job_id", (F.col("open_before") + F.col("place") - F.col("first")).alias("r"), "place")


def unprofiled_configs(types: DataFrame, configs: DataFrame, claims: DataFrame) -> DataFrame:
    """J-04. (job_id, n_gpus, config_key) for every valid configuration without a claim."""
    ranked = rank_configs(configs)
    found = open_places(open_gaps(types, ranked, claimed_places(claims, ranked)))
    return found.join(ranked, "place").select("job_id", "n_gpus", "config_key")


def next_config(types: DataFrame, configs: DataFrame, claims: DataFrame) -> DataFrame:
    """W-03. The smallest un-profiled configuration per type; types with none are left out."""
    ranked = rank_configs(configs)
    gaps = open_gaps(types, ranked, claimed_places(claims, ranked)).where("open_before = 0")
    first = gaps.groupBy("job_id").agg(F.min("first").alias("place"))
    return first.join(ranked, "place").select("job_id", "config_key", "n_gpus")


def blocked_places(types: DataFrame, placed: DataFrame, claims: DataFrame, held: DataFrame) -> DataFrame:
    """(job_id, k, k_config) for types whose way is blocked: the first open configuration that no node can take.

    ``placed`` are ranked configurations with a ``fit_node``, ``held`` their claimed places. Among the
    configurations without a node, the first that a type has not claimed is the first number its claims lack.
    """
    unfit = placed.where("fit_node IS NULL").select("config_key", "n_gpus", F.col("place").alias("_place"))
    unfit = rank_configs(unfit)
    own = claims.select("job_id", "config_key").distinct().join(unfit.select("config_key", "place"), "config_key")
    own = own.withColumn("_j", F.row_number().over(Window.partitionBy("job_id").orderBy("place")) - 1)
    lacks = own.groupBy("job_id").agg(F.coalesce(F.min(F.when(F.col("place") > F.col("_j"), F.col("_j"))), F.count(F.lit(1))).alias("_lacks"))
    wanted = types.select("job_id").distinct().join(lacks, "job_id", "left")
    wanted = wanted.select("job_id", F.coalesce("_lacks", F.lit(0)).cast("bigint").alias("place"))
    first = wanted.join(unfit, "place").select("job_id", F.col("config_key").alias("k_config"), "_place")
    below = first.join(held, "job_id", "left").groupBy("job_id", "k_config", "_place")
    below = below.agg(F.count_if(F.col("place") < F.col("_place")).alias("_below"))
    return below.select("job_id", (F.col("_place") - F.col("_below")).alias("k"), "k_config")


def config_grid(types: DataFrame, configs: DataFrame, claims: DataFrame) -> DataFrame:
    """J-06. Every valid configuration of each type with its result; ``is_best`` marks the
    fastest result of the type."""
    ranked = rank_configs(configs)
    total = ranked.agg(F.count(F.lit(1))).scalar()
    every = types.select("job_id").distinct().where(total > 0)
    every = every.select("job_id", F.explode(F.sequence(F.lit(0).cast("bigint"), total - 1)).alias("place"))
    cells = every.join(ranked, "place").select("job_id", "n_gpus", "config_key")
    results = claims.select("job_id", "config_key", "node_id", "duration_seconds")
    best = best_config(claims).select("job_id", F.col("config_key").alias("_best"))
    return (
        cells.join(results, ["job_id", "config_key"], "left")
        .join(best, "job_id", "left")
        .withColumn("status", F.when(F.col("duration_seconds").isNotNull(), "done").otherwise("pending"))
        .withColumn("is_best", F.coalesce(F.col("config_key") == F.col("_best"), F.lit(False)))
        .drop("_best")
    )


def coverage(types: DataFrame, configs: DataFrame, claims: DataFrame) -> DataFrame:
    """A-07. Claims per type, those completed, and both against the number of valid
    configurations; NULL percentages when there are none."""
    counted = claims.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("claimed"), F.count("duration_seconds").alias("completed")
    )
    zero = F.lit(0).cast("bigint")
    total = configs.agg(F.count(F.lit(1))).scalar()
    return (
        types.select("job_id")
        .distinct()
        .join(counted, "job_id", "left")
        .select(
            "job_id",
            F.coalesce("claimed", zero).alias("claimed"),
            F.coalesce("completed", zero).alias("completed"),
            total.alias("valid"),
        )
        .withColumn("claimed_pct", 100.0 * F.col("claimed") / F.nullif("valid", F.lit(0)))
        .withColumn("completed_pct", 100.0 * F.col("completed") / F.nullif("valid", F.lit(0)))
    )


def best_config(claims: DataFrame) -> DataFrame:
    """A-08. The fastest measured configuration per type; types with none are left out."""
    measured = claims.where(F.col("duration_seconds").isNotNull())
    best = measured.groupBy("job_id").agg(
        F.min(F.struct("duration_seconds", "config_key", "node_id")).alias("best")
    )
    return best.select("job_id", "best.config_key", "best.duration_seconds", "best.node_id")


def available_config(types: DataFrame, claims: DataFrame, node_free: DataFrame) -> DataFrame:
    """J-05. Per type the first measured configuration some node can run now, profiling nodes
    included; order: fewest GPUs, then key. NULL when nothing fits.

    Only configurations that were measured are fitted, each once, whatever else the nodes could run.
    """
    measured = claims.where(F.col("duration_seconds").isNotNull())
    fits = fitting_configs(distinct_configs(measured), node_free).select("config_key", "n_gpus", "node_id")
    first = F.min(F.struct("n_gpus", "config_key", "node_id")).alias("first")
    found = measured.select("job_id", "config_key").distinct().join(fits, "config_key").groupBy("job_id").agg(first)
    wanted = types.select("job_id").distinct()
    return wanted.join(found, "job_id", "left").select("job_id", "first.config_key", "first.node_id")
