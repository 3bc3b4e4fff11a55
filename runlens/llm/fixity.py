"""Merkle fixity audit of replicas of WARC files.

Every record is hashed. Ordered ranges of offsets are hashed over the records that begin in them, wider ranges over
narrower ones, up to a file, then groups of files up to one root. Two replicas are compared from the root: only the
children of nodes that differ are looked at, level by level, down to the records that differ.

A node is a row (level, file, range): level 0 is a record at its offset, level 1 a range of ``BLOCK`` bytes, every
further level ``FANOUT`` of the one below; above the highest range level, files are grouped in the same way. A node has at most
FANOUT children, and a range of BLOCK bytes a bounded number of records, so no group grows with the data, also
where one file holds a third of it.

Defined cases: a null page id counts as -1, null html and urls as empty, a
null record has a hash of its own; several records at one offset are one leaf, of their
smallest and greatest hash and their number; equal replicas, and two empty ones, give no rows; a replica that lacks a
whole branch differs in every record of it. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import written
from runlens.plans.ordered import running_sum, with_ordered

PAGES_PER_FILE = 1_000
BLOCK = 1 << 16
FANOUT = 16


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """One response record as bytes."""
    body = F.encode(html, "UTF-8")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        page_id.cast("string"),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def warc_records(pages: DataFrame, per_file: int = PAGES_PER_FILE) -> DataFrame:
    """(file, offset, length, page_id, record): pages in the order of their ids, ``per_file`` ids to a file."""
    empty = F.lit("")
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1)).alias("page_id"),
        F.coalesce("url", empty).alias("url"),
        F.coalesce("html", empty).alias("html"),
    )
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = rows.select("page_id", "url", record.alias("record"))
    rows = rows.withColumn("length", F.octet_length("record").cast("bigint"))
    rows = rows.withColumn("file", F.floor(F.col("page_id") / per_file).cast("bigint"))
    rows = with_ordered(rows, ["file"], ["page_id", "url", "length"], {"_end": running_sum("length")})
    return rows.select("file", (F.col("_end") - F.col("length")).alias("offset"), "length", "page_id", "record")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0: one node per file and offset."""
    digest = records.select("file", "offset", F.coalesce(F.sha2("record", 256), F.lit("null")).alias("hash"))
    leaf = digest.groupBy("file", "offset").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.count(F.lit(1)).alias("n"))
    several = F.sha2(F.concat_ws(",", "a", "b", F.col("n").cast("string")), 256)
    hash_ = F.when(F.col("n") == 1, F.col("a")).otherwise(several)
    return leaf.select(F.lit(0).alias("level"), "file", F.col("offset").alias("range"), hash_.alias("hash"))


def parent(level: int, top: int, block: int = BLOCK, fanout: int = FANOUT) -> tuple[Column, Column]:
    """File and range of the parent of a node of this level; ``top`` is the level of whole files."""
    if level == 0:
        return F.col("file"), F.floor(F.col("range") / block).cast("bigint")
    if level < top:
        return F.col("file"), F.floor(F.col("range") / fanout).cast("bigint")
    return F.floor(F.col("file") / fanout).cast("bigint"), F.lit(0).cast("bigint")


def levels(replicas: list[DataFrame], block: int = BLOCK, fanout: int = FANOUT) -> tuple[int, int]:
    """The level of whole files and the level of the root, for trees over all of these leaves."""
    both = replicas[0].select("file", "range").union(replicas[1].select("file", "range"))
    most, low, high = both.agg(F.max("range"), F.min("file"), F.max("file")).first()
    if most is None:
        return 1, 1
    top, span = 1, block
    while span <= most:
        top, span = top + 1, span * fanout
    root = top
    while low != high:
        low, high, root = low // fanout, high // fanout, root + 1
    return top, root


def tree(leaf: DataFrame, top: int, root: int, block: int = BLOCK, fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes of each level, leaves first, each written to the shared folder."""
    spark = leaf.sparkSession
    out = [leaf]
    for level in range(root):
        file, range_ = parent(level, top, block, fanout)
        children = F.sort_array(F.collect_list(F.struct("file", "range", "hash")))
        said = F.transform("_children", lambda c: F.concat_ws(":", c["file"].cast("string"), c["range"].cast("string"), c["hash"]))
        nodes = out[-1].select(file.alias("_file"), range_.alias("_range"), "file", "range", "hash")
        nodes = nodes.groupBy("_file", "_range").agg(children.alias("_children"))
        nodes = nodes.select(
            F.lit(level + 1).alias("level"),
            F.col("_file").alias("file"),
            F.col("_range").alias("range"),
            F.sha2(F.array_join(said, ","), 256).alias("hash"),
        )
        out.append(written(spark, nodes, "tree"))
    return out


def audit(replica: DataFrame, other: DataFrame, block: int = BLOCK, fanout: int = FANOUT) -> DataFrame:
    """(file, offset, kind) of every record that differs: changed, missing from ``other`` or extra in it.

    Both have file, offset and record.
    """
    spark = replica.sparkSession
    bottom = [written(spark, leaves(r), "leaves") for r in (replica, other)]
    top, root = levels(bottom, block, fanout)
    a, b = (tree(leaf, top, root, block, fanout) for leaf in bottom)
    differing = None
    for level in reversed(range(root + 1)):
        left, right = a[level], b[level]
        if differing is not None:
            file, range_ = parent(level, top, block, fanout)
            left, right = (_below(side, differing, file, range_) for side in (left, right))
        right = right.select("file", "range", F.col("hash").alias("other"))
        met = left.select("file", "range", "hash").join(right, ["file", "range"], "full")
        differing = written(spark, met.where(~F.col("hash").eqNullSafe(F.col("other"))), "differing")
    kind = F.when(F.col("other").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("changed")
    return differing.select("file", F.col("range").alias("offset"), kind.alias("kind"))


def _below(nodes: DataFrame, differing: DataFrame, file: Column, range_: Column) -> DataFrame:
    """The nodes whose parent differs."""
    above = differing.select(F.col("file").alias("_file"), F.col("range").alias("_range"))
    return nodes.withColumn("_file", file).withColumn("_range", range_).join(above, ["_file", "_range"], "left_semi")
