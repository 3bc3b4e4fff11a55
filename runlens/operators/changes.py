"""What changed between two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The multiset difference of two versions: each row that is in one more often, with ``change`` (added or removed)
    and ``copies``, how much more often.

    Both sides are counted in one aggregate, combined before the shuffle, so rows that did not change cost one group and
    no join. NULLs equal NULLs. Columns must be groupable: maps go by a key column.
    """
    sides = [t.select(*before.columns).withColumn("_n", F.lit(n).cast("bigint")) for t, n in ((before, -1), (after, 1))]
    counted = sides[0].union(sides[1]).groupBy(*before.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    change = F.when(F.col("_n") > 0, "added").otherwise("removed").alias("change")
    return counted.select(change, F.abs("_n").alias("copies"), *before.columns)


def apply_diff(before: DataFrame, diff: DataFrame) -> DataFrame:
    """The version that ``diff`` leads to: ``apply_diff(a, table_diff(a, b))`` has the rows of ``b``, as often."""
    sign = F.when(F.col("change") == "added", F.col("copies")).otherwise(-F.col("copies"))
    changes = diff.select(*before.columns, sign.alias("_n"))
    counted = before.withColumn("_n", F.lit(1).cast("bigint")).unionByName(changes)
    counted = counted.groupBy(*before.columns).agg(F.sum("_n").cast("int").alias("_n")).where("_n > 0")
    return counted.select(*before.columns, F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_copy")).drop("_copy")


def column_changes(diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, field, before, after), values as text, for keys that lost one row and got another.

    Keys that came, went, or have several rows are left to the rows of ``diff``. NULL keys are keys.
    """
    keys = list(keys)
    values = [c for c in diff.columns if c not in (*keys, "change", "copies")]
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in values])

    def side(name: str) -> tuple:
        here = F.col("change") == name
        return F.max(F.when(here, row)).alias(name), F.coalesce(F.sum(F.when(here, F.col("copies"))), F.lit(0)).alias(f"_{name}")

    paired = diff.groupBy(*keys).agg(*side("removed"), *side("added")).where("_removed = 1 AND _added = 1")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col("removed")[c].alias("before"), F.col("added")[c].alias("after")) for c in values])
    differing = F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))
    return paired.select(*keys, F.inline(differing))

