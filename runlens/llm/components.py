"""Connected components of a table of links, by alternating stars.

Each round joins every node with its smallest neighbour and replaces links by links to that neighbour, until only
stars around the smallest node of each component are left. Rounds grow with the logarithm of the longest chain.
Every step is written to the shared folder, so a lost executor costs a step at most, and both sides of a join come
straight from files, so adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import new_folder


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame, written to the shared folder and read again."""
    folder = new_folder(spark, name)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def _state(links: DataFrame) -> tuple:
    wide = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(wide)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link: ``links`` has bigint columns a and b.

    The component is its smallest node. Links with a null end, links of a node with itself and repeated links
    say nothing. No links give no rows.
    """
    spark = links.sparkSession
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    links = written(spark, links.where("a <> b").select(high, low).distinct(), "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(spark, both.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = written(spark, larger.distinct(), "links")
        least = written(spark, links.groupBy("a").agg(F.min("b").alias("least")), "least")
        smaller = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        own = least.select("a", F.col("least").alias("b"))
        links = written(spark, smaller.union(own).distinct(), "links")
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
