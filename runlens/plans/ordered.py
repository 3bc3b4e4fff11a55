"""Ordered computations and joins per group that stay parallel when one group is huge.

A plain window sends every row of a group to one task. Here the largest groups are cut into
chunks of consecutive rows, the window runs per (group, chunk), and each chunk is corrected
with what the chunks before it add up to.

* Which groups: those with at least ``min_rows`` rows; of more than ``MAX_GROUPS`` such groups the
  largest, so a group left whole is small or holds less than 1/65,536 of all rows.
* Into how many chunks: one for ``min_rows / 4`` rows, or for 1/262,144 of the rows of all hot groups
  if that is more, and at most ``MAX_CHUNKS`` in one group.
* Where to cut: at quantiles of the full order, ties included, read off a sample of the group: 64
  rows a chunk, ``SAMPLE_ROWS`` at least. The cuts only steer the distribution of work; the results are
  exact wherever they fall. The rows are chosen by hash and sorted, so every evaluation of the plan, a
  retried task's included, cuts in the same places. A row finds its chunk by halving the list of its
  group's cuts.
* What is broadcast: cuts and corrections, at most one per chunk: two in 1/262,144 of the rows, four
  a group, so below 524,288 of them however large the data is.

Without a large group the extra work is one count per group: adaptive execution drops the
rest of the plan once that count comes back empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType


#: Bounds of what is broadcast, whatever the data: groups cut, chunks of them all together, and of one.
MAX_GROUPS, ALL_CHUNKS, MAX_CHUNKS = 1 << 16, 1 << 18, 1 << 12
SAMPLE_ROWS = 16_384


@dataclass(frozen=True)
class HotGroups:
    """When a group is cut, and into how many chunks; by its rows unless ``chunks`` says it."""

    min_rows: int = 4_000_000
    max_groups: int = MAX_GROUPS
    chunks: int | None = None


DEFAULT = HotGroups()


@dataclass(frozen=True)
class Ordered:
    """One computed column: ``kind`` is row_number, previous, last_value, running_max or running_sum."""

    kind: str
    column: str | None = None


def row_number() -> Ordered:
    return Ordered("row_number")


def previous(column: str) -> Ordered:
    return Ordered("previous", column)


def last_value(column: str) -> Ordered:
    """The latest value that is not NULL, the row's own included."""
    return Ordered("last_value", column)


def running_max(column: str) -> Ordered:
    return Ordered("running_max", column)


def running_sum(column: str) -> Ordered:
    return Ordered("running_sum", column)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key, other in zip(keys, renamed, strict=True):
        condition = condition & left[key].eqNullSafe(right[other])
    return condition


def largest_groups(df: DataFrame, keys: Sequence[str], names: Sequence[str], hot: HotGroups) -> DataFrame:
    """The hot groups' keys, as ``names``, with their ``_rows`` and ``_chunks``: at most ``max_groups`` rows."""
    largest = (
        df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") >= hot.min_rows)
        .orderBy(F.desc("_rows"), *names)
        .limit(hot.max_groups)
    )
    if hot.chunks:
        return largest.withColumn("_chunks", F.lit(hot.chunks))
    # The limit has left one partition of bounded size, so this sum moves nothing.
    share = F.sum("_rows").over(Window.partitionBy(F.lit(0))) / ALL_CHUNKS
    chunks = F.ceil(F.col("_rows") / F.greatest(share, F.lit(hot.min_rows / 4)))
    return largest.withColumn("_chunks", F.least(F.greatest(chunks, F.lit(2)), F.lit(MAX_CHUNKS)).cast("int"))


def join_unique(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot: HotGroups = DEFAULT,
    how: str = "left",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left or inner join to a table with one row per key, when some keys may hold much of
    ``left``.

    Rows of a hot key are spread over its ``_chunks`` parts, and its one partner is repeated for each
    part. NULL keys match nothing and may be hot too. Spark splits skewed joins itself, but not
    where an aggregate gives one side of the join. ``counted`` may be a cheaper frame to count
    the keys in; it need only hold every hot key.
    """
    keys = list(keys)
    names = [f"_hot_{i}" for i in range(len(keys))]
    largest = largest_groups(left if counted is None else counted, keys, names, hot).drop("_rows")
    largest = F.broadcast(largest)
    hashable = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    spread = F.pmod(F.xxhash64(*hashable), F.col("_chunks"))
    first = F.lit(0).cast("bigint")
    one = left.join(largest, _same(left, largest, keys, names), "left").withColumn("_part", F.coalesce(spread, first))
    parts = F.coalesce(F.sequence(first, F.col("_chunks").cast("bigint") - 1), F.array(first))
    other = right.join(largest, _same(right, largest, keys, names), "left").withColumn("_part", F.explode(parts))
    return one.drop("_chunks", *names).join(other.drop("_chunks", *names), [*keys, "_part"], how).drop("_part")


def _number_passed(cuts: str, value: Column, chunks: int) -> Column:
    """How many of the ascending ``cuts``, fewer than ``chunks``, the value has reached, by halving the range."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range((chunks - 1).bit_length()))])

    def take(passed: Column, step: Column) -> Column:
        return passed + F.when(F.get(cuts, passed + step - 1) <= value, step).otherwise(0)

    return F.aggregate(steps, F.lit(0), take)


def cut_hot_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    hot: HotGroups = DEFAULT,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add ``_chunk``: 0 for ordinary groups, a rising number along ``order`` for hot ones, and
    ``_is_hot``. Groups are counted and cut by the rows of ``counted``, if
    given."""
    source = df if counted is None else counted
    names = [f"_hot_{i}" for i in range(len(keys))]
    largest = largest_groups(source, keys, names, hot)
    narrow = source.select(*keys, F.struct(*order).alias("_at"), F.xxhash64(*order).alias("_spread"))
    sample = F.greatest(F.lit(SAMPLE_ROWS), F.col("_chunks") * 64)
    places = F.sequence(F.lit(1), F.col("_chunks") - 1)
    cuts = (
        narrow.join(F.broadcast(largest), _same(narrow, largest, keys, names))
        .where(F.pmod("_spread", F.greatest(F.floor(F.col("_rows") / sample), F.lit(1))) == 0)
        .groupBy(*names, "_chunks")
        .agg(F.sort_array(F.collect_list("_at")).alias("_seen"))
        .select(
            *names,
            F.array_distinct(
                F.transform(places, lambda i: F.get("_seen", F.floor(i * F.size("_seen") / F.col("_chunks")).cast("int")))
            ).alias("_cuts"),
        )
    )
    marked = df.join(F.broadcast(cuts), _same(df, cuts, keys, names), "left")
    passed = _number_passed("_cuts", F.struct(*order), hot.chunks or MAX_CHUNKS)
    return (
        marked.withColumn("_chunk", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(passed))
        .withColumn("_is_hot", F.col("_cuts").isNotNull())
        .drop("_cuts", *names)
    )


@dataclass
class _Parts:
    within: dict[str, Column] = field(default_factory=dict)
    totals: dict[str, Column] = field(default_factory=dict)
    carried: dict[str, Column] = field(default_factory=dict)
    joined: dict[str, Column] = field(default_factory=dict)


def with_ordered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, Ordered],
    hot: HotGroups = DEFAULT,
    cut_by: tuple[DataFrame, Sequence[str]] | None = None,
) -> DataFrame:
    """Add the ordered ``columns`` to ``df``, grouped by ``keys`` and ascending by ``order``.

    ``order`` must give every row of a group its own place. ``cut_by`` may name a frame, and some of the keys, that are cheaper
    to find hot groups in: cuts made for a larger group serve every group within it.
    """
    keys, order = list(keys), list(order)
    counted, cut_keys = cut_by or (df, keys)
    chunked = cut_hot_groups(df, cut_keys, order, hot, counted)
    names = [f"_of_{i}" for i in range(len(keys))]

    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_chunk = Window.partitionBy(*names).orderBy("_before")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)

    parts = _Parts()
    parts.within["_local_row"] = F.row_number().over(local)
    for name, spec in columns.items():
        here, total, carry = f"_here_{name}", f"_total_{name}", f"_carry_{name}"
        if spec.kind == "row_number":
            parts.within[here] = F.row_number().over(local).cast("bigint")
            parts.totals[total] = F.count(F.lit(1))
            parts.carried[carry] = F.sum(total).over(earlier)
            parts.joined[name] = F.col(here) + F.coalesce(carry, F.lit(0))
        elif spec.kind == "previous":
            # Boxed, so that a NULL on the last row is carried as a value. The last row has the
            # greatest first order column; only other columns must be looked up on that row.
            last = F.max(spec.column) if spec.column == order[0] else F.max_by(spec.column, F.struct(*order))
            parts.within[here] = F.lag(spec.column).over(local)
            parts.totals[total] = F.struct(last.alias("v"))
            parts.carried[carry] = F.lag(total).over(by_chunk)
            parts.joined[name] = F.when(F.col("_local_row") == 1, F.col(carry)["v"]).otherwise(F.col(here))
        elif spec.kind == "last_value":
            there = F.when(F.col(spec.column).isNotNull(), F.struct(*order))
            parts.within[here] = F.last(spec.column, ignorenulls=True).over(so_far)
            parts.totals[total] = F.max_by(spec.column, there)
            parts.carried[carry] = F.last(total, ignorenulls=True).over(earlier)
            parts.joined[name] = F.coalesce(here, carry)
        elif spec.kind == "running_max":
            parts.within[here] = F.max(spec.column).over(so_far)
            parts.totals[total] = F.max(spec.column)
            parts.carried[carry] = F.max(total).over(earlier)
            parts.joined[name] = F.greatest(here, carry)
        elif spec.kind == "running_sum":
            parts.within[here] = F.sum(spec.column).over(so_far)
            parts.totals[total] = F.sum(spec.column)
            parts.carried[carry] = F.sum(total).over(earlier)
            parts.joined[name] = F.coalesce(F.col(here) + F.col(carry), here, carry)
        else:
            raise ValueError(f"unknown ordered column kind {spec.kind!r}")

    totals = (
        chunked.where("_is_hot")
        .groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_chunk").alias("_before"))
        .agg(*[c.alias(n) for n, c in parts.totals.items()])
    )
    carried = totals.select(*names, "_before", *[c.alias(n) for n, c in parts.carried.items()])

    scanned = chunked.withColumns(parts.within)
    match = _same(scanned, carried, keys, names) & (scanned["_chunk"] == carried["_before"])
    # Keys beyond those the cuts were made by multiply the corrections. Three values of a boolean
    # keep them bounded; with any other such key it is left to Spark to look at their size.
    finer = [f for f in df.schema if f.name in keys and f.name not in cut_keys]
    if all(isinstance(f.dataType, BooleanType) for f in finer):
        carried = F.broadcast(carried)
    return scanned.join(carried, match, "left").select(
        *[scanned[c] for c in df.columns], *[c.alias(n) for n, c in parts.joined.items()]
    )


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each group under ``order``, which must leave no ties.

    A minimum is combined inside each input task before the shuffle, so a hot group costs no
    more than a cold one. NULLs in ``order`` come first. Columns ordered by are named where
    possible: they are then carried once, as the order, and not again with the row.
    """
    named = [c for c in order if isinstance(c, str) and c not in keys]
    payload = [c for c in df.columns if c not in keys and c not in named]
    place = F.struct(*order)
    first = df.groupBy(*keys).agg(F.min(place).alias("_order"), F.min_by(F.struct(*payload), place).alias("_row"))
    return first.select(
        *[F.col(c) if c in keys else F.col("_order" if c in named else "_row")[c].alias(c) for c in df.columns]
    )
