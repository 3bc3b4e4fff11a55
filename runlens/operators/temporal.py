"""Matching and counting over time: states as of a moment, overlapping intervals, concurrency, sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.plans.ordered import DEFAULT, HotGroups, cut_hot_groups, last_value, previous, row_number, running_sum, with_ordered

#: Intervals up to so long are of the lowest level, in seconds.
BASE_SECONDS = 3600


def as_of(
    rows: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    time: str,
    carried: Sequence[str],
    since: str = "since",
    tie: Sequence[str] = (),
    hot: HotGroups = DEFAULT,
) -> DataFrame:
    """Add to each row the ``carried`` columns of the last state of its key at or before its ``time``.

    Rows and states of a key are put in one order and the last state is carried along it, so nothing is joined by
    inequality and a key with a third of all rows is cut like any hot group. Of states of one moment, the last by
    ``tie`` counts. Rows without a state, a key or a time get NULLs; states without a key or time are left out.
    """
    keys = list(keys)
    named = states.where(" AND ".join(f"{k} IS NOT NULL" for k in [*keys, since]))
    changes = named.select(
        *keys, F.col(since).alias("_time"), F.lit(0).alias("_side"), F.struct(F.lit(0).alias("_none"), *tie).alias("_tie"), F.struct(*carried).alias("_state")
    )
    asked = rows.select(*keys, F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    both = changes.unionByName(asked, allowMissingColumns=True)
    placed = with_ordered(both, keys, ["_time", "_side", "_tie"], {"_last": last_value("_state")}, hot, cut_by=(both.select(*keys, "_time", "_side", "_tie"), keys))
    return placed.where("_side = 1").select("_row.*", *[F.col("_last")[c].alias(c) for c in carried])


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def _levelled(intervals: DataFrame, base: int) -> DataFrame:
    """Intervals that are not empty, with their ends in microseconds and the level whose buckets are as long as they."""
    ends = intervals.withColumn("_from", _micros("start")).withColumn("_to", _micros("end")).where("_to > _from")
    length = (F.col("_to") - F.col("_from")) / F.lit(base)
    return ends.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1.0))))).cast("int"))


def _bucketed(intervals: DataFrame, levels: list[int], base: int) -> DataFrame:
    """A row for each bucket: at the interval's own level and at each longer one of the other side, two or three apiece."""
    longer = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x > F.col("_level")) if levels else F.array().cast("array<int>")
    at = intervals.withColumn("_at", F.explode(F.concat(F.array("_level"), longer)))
    size = F.lit(base) * F.pow(F.lit(2), F.col("_at")).cast("bigint")
    buckets = F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))
    return at.withColumn("_size", size).withColumn("_bucket", F.explode(buckets))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], base_seconds: int = BASE_SECONDS) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose half-open intervals [``start``, ``end``) overlap, with ``from`` and ``to`` of the overlap.

    Buckets of time are twice as long on each level, and an interval belongs to the level whose buckets are about as long
    as it is. Pairs meet by equality of key, level and bucket on the longer one's level, once: in the bucket where the later of them begins. So
    a run of months costs two or three rows a level and not one an hour. Columns other than the keys must differ in
    name; empty intervals and NULL keys or ends overlap nothing.
    """
    keys = list(keys)
    base = base_seconds * 1_000_000
    sides = [_levelled(side, base) for side in (left, right)]
    # At most 64 levels: the length of a bucket doubles from one to the next.
    levels = [sorted(r["_level"] for r in side.select("_level").distinct().collect()) for side in sides]
    one = _bucketed(sides[0], levels[1], base).withColumnsRenamed({"_from": "_from1", "_to": "_to1", "_level": "_level1"}).drop("start", "end")
    two = _bucketed(sides[1], levels[0], base).withColumnsRenamed({"_from": "_from2", "_to": "_to2", "_level": "_level2"}).drop("start", "end", "_size")
    met = one.join(two, [*keys, "_at", "_bucket"]).where("_from1 < _to2 AND _from2 < _to1 AND _at = greatest(_level1, _level2)")
    met = met.where(F.col("_bucket") == F.floor(F.greatest("_from1", "_from2") / F.col("_size")))
    overlap = F.timestamp_micros(F.greatest("_from1", "_from2")).alias("from"), F.timestamp_micros(F.least("_to1", "_to2")).alias("to")
    names = [c for c in met.columns if not c.startswith("_")]
    return met.select(*names, *overlap)


def in_use(intervals: DataFrame, keys: Sequence[str], amount: str, hot: HotGroups = DEFAULT) -> DataFrame:
    """(keys, moment, in_use): how much is in use from each moment on at which it changes, by a sweep over starts and ends.

    What starts and ends at one moment is summed before the shuffle; a key with very many moments is swept in chunks.
    """
    keys, n = list(keys), F.col(amount).cast("bigint")
    live = intervals.where(F.col("end") > F.col("start"))
    starts = live.select(*keys, F.col("start").alias("moment"), n.alias("_change"))
    ends = live.select(*keys, F.col("end").alias("moment"), (-n).alias("_change"))
    steps = starts.unionByName(ends).groupBy(*keys, "moment").agg(F.sum("_change").alias("_change"))
    return with_ordered(steps, keys, ["moment"], {"in_use": running_sum("_change")}, hot).drop("_change")


def peak_use(intervals: DataFrame, keys: Sequence[str], amount: str, hot: HotGroups = DEFAULT) -> DataFrame:
    """(keys, peak, peak_at): the most that is in use at once, and since when first."""
    used = in_use(intervals, keys, amount, hot)
    top = used.groupBy(*keys).agg(F.max("in_use").alias("peak"), F.min(F.struct((-F.col("in_use")).alias("less"), "moment")).alias("_first"))
    return top.select(*keys, "peak", F.col("_first.moment").alias("peak_at"))


def sessions(lines: DataFrame, keys: Sequence[str], time: str, gap: str) -> DataFrame:
    """(keys, session_start, last_line, n_lines): stretches of lines with no more than ``gap`` between one and the next.

    Works on streams with a watermark too: a session comes out once the watermark has passed its end.
    """
    window = F.session_window(time, gap).alias("_session")
    found = lines.where(F.col(time).isNotNull()).groupBy(*keys, window)
    found = found.agg(F.min(time).alias("session_start"), F.max(time).alias("last_line"), F.count(F.lit(1)).alias("n_lines"))
    return found.drop("_session")


def stalls(found: DataFrame, keys: Sequence[str], hot: HotGroups = DEFAULT) -> DataFrame:
    """(keys, stalled_from, stalled_to, n_stall): the silences between the sessions of a key, numbered."""
    placed = with_ordered(found, keys, ["session_start"], {"stalled_from": previous("last_line"), "_place": row_number()}, hot)
    placed = placed.where("stalled_from IS NOT NULL")
    return placed.select(*keys, "stalled_from", F.col("session_start").alias("stalled_to"), (F.col("_place") - 1).alias("n_stall"))


def rolling(rows: DataFrame, keys: Sequence[str], time: str, seconds: int, columns: dict[str, Column], hot: HotGroups = DEFAULT) -> DataFrame:
    """Add aggregates over the ``seconds`` up to and with each row's ``time`` (a RANGE frame), ties included.

    Large groups are cut into chunks by time. A chunk also gets the rows before it that its frames reach, for the window only,
    so a hot group is worked on in many tasks. Rows without a time get aggregates over such rows alone.
    """
    keys = list(keys)
    width = seconds * 1_000_000
    placed = rows.withColumn("_at", _micros(time))
    cut = cut_hot_groups(placed, keys, ["_at"], hot)
    names = [f"_of_{k}" for k in keys]
    begins = cut.where("_is_hot").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_chunk").alias("_to"))
    # At most a row for each chunk of a hot group.
    begins = F.broadcast(begins.agg(F.min("_at").alias("_begins")))
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)])
    reach = (F.col("_chunk") < F.col("_to")) & (F.col("_at") >= F.col("_begins") - width)
    before = cut.where("_is_hot").join(begins, match & reach).drop(*names, "_chunk", "_begins").withColumnRenamed("_to", "_chunk")
    both = cut.withColumn("_own", F.lit(True)).unionByName(before.withColumn("_own", F.lit(False)))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_at").rangeBetween(-width, Window.currentRow)
    return both.withColumns({n: c.over(frame) for n, c in columns.items()}).where("_own").select(*rows.columns, *columns)
