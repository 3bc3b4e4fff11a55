"""Stored sketches: small summaries per day that merge over any range of days.

Quantiles come from KLL sketches and distinct counts from HLL sketches. A merged sketch is as good as one built over all
rows at once, so a month is read from thirty small rows per key and not from its lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank error of a quantile, with k = 200: at most so much of all rows, 99 times of 100.
KLL_K, RANK_ERROR = 200, 0.0165
#: Relative error of a distinct count with 2^12 registers: 1.04 / 2^6 is one standard deviation; three are taken.
HLL_LG, COUNT_ERROR = 12, 3 * 1.04 / 64


def daily_sketches(rows: DataFrame, keys: Sequence[str], time: str, value: str, member: str) -> DataFrame:
    """(keys, day, n, values, members): per key and day a sketch of ``value`` and one of the distinct ``member``.

    Sketches are built inside each task and merged in the shuffle. NULL values and members are left out of them.
    """
    rows = rows.withColumn("day", F.to_date(time))
    return rows.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("n"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("values"),
        F.hll_sketch_agg(member, F.lit(HLL_LG)).alias("members"),
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of some days as one per key; choose the days by a filter, which reaches the stored table."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("values", F.lit(KLL_K)).alias("values"), F.hll_union_agg("members").alias("members")
    )


def estimates(sketches: DataFrame, keys: Sequence[str], quantile: float) -> DataFrame:
    """(keys, n, quantile_value, n_distinct) read off sketches."""
    value = F.kll_sketch_get_quantile_double("values", F.lit(quantile)).alias("quantile_value")
    return sketches.select(*keys, "n", value, F.hll_sketch_estimate("members").alias("n_distinct"))
