"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and applies one operator to all of docs.

All but the last return the columns of docs, whatever further columns those have. Rows with a null doc_id are never
taken for copies of another and are kept by the stages that judge by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens.llm import decontaminate, jaccard, mixing, repeats, substrings, toxicity
from runlens.llm.batches import bound_batches
from runlens.llm.components import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, gone: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """docs without the ids in ``gone``, and with one row of each id in ``repeated``.

    Only rows that a bitmap of those ids does not rule out are moved to look exactly.
    """
    ids = gone if repeated is None else gone.union(repeated)
    bits = repeats.bitmap_bits(ids.count())
    marks = repeats.bitmap_of(ids, bits)
    named = docs.where("doc_id is not null")
    doubtful = repeats.among(named, marks)
    doubtful = doubtful.join(gone, doubtful["doc_id"] == gone["doc_id"], "left_anti")
    if repeated is not None:
        first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        doubtful = doubtful.withColumn("_nth_of_id", first).where("_nth_of_id = 1").drop("_nth_of_id")
    return repeats.among(named, marks, inside=False).union(doubtful).union(docs.where("doc_id is null"))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from the labels that are not held out, does not reject."""
    bound_batches(spark)
    model = toxicity.learned(docs, _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(model) < toxicity.THRESHOLD)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    bound_batches(spark)
    placed = written(spark, jaccard.jaccard_join(docs).where("doc_id is not null"), "placed")
    gone = placed.where("component_id < doc_id").select("doc_id").distinct()
    repeated = placed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return _without(docs, gone, repeated)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a smaller id has too; ``n_chars`` follows the text."""
    bound_batches(spark)
    left = substrings.remove_repeats(docs, carry=True)
    columns = {c: F.col("text") if c == "text" else F.col("row")[c] for c in docs.columns}
    if "n_chars" in columns:
        now = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, now).otherwise(columns["n_chars"])
    return left.select(*[value.alias(name) for name, value in columns.items()])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item."""
    bound_batches(spark)
    found = decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    return _without(docs, written(spark, found.where("doc_id is not null").select("doc_id").distinct(), "contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often, and as far, as its source's target takes it."""
    return mixing.copies(docs)
