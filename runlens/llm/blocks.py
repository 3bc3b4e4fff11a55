"""Groups whose rows are compared with one another, in blocks of bounded size.

A group of more rows than a block may hold is dealt into chunks by hash, and every pair of its chunks is a block:
each row goes once to every chunk of its own group, so no group is one task's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many groups are larger than a block: the list of them is broadcast.
MOST_LARGE = 1 << 16


def in_blocks(rows: DataFrame, keys: list[str], name: str, most: int) -> DataFrame:
    """``rows`` with the chunk of each row and the block (first, second) it goes to.

    ``name`` is the column whose hash deals the rows. Blocks hold about two chunks of ``most`` rows, or of a
    65,536th of all rows if that is more. Null keys are groups like any other.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    chunk = max(most, -(-total // MOST_LARGE))
    large = sizes.where(F.col("_n") > chunk).select(*(F.col(k).alias(f"_{k}") for k in keys), F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks"))
    same = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}")) if same is None else same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = rows.join(F.broadcast(large), same, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    met = met.withColumn("chunk", F.pmod(F.xxhash64(name), F.col("_chunks")).cast("int"))
    met = met.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    met = met.withColumn("first", F.least("chunk", "_with")).withColumn("second", F.greatest("chunk", "_with"))
    return met.drop("_chunks", "_with", *(f"_{k}" for k in keys))
