"""The registered queries of this folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import cells, chat, decontaminate, fixity, importance, jaccard, mixing, negatives, pages, quality, spelling, sql, substrings, toxicity
from runlens.llm.batches import bound_batches
from runlens.llm.components import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", F.coalesce(toxicity.is_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), toxicity.toxicity(model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of every document, and whether the cascade of rules keeps it."""
    return quality.assess(table(spark, sf_dir, "documents"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica with records changed, cut short and lost.

    The replica is derived from the pages: by page id, some records lose their last byte, some have one replaced, and
    some are missing.
    """
    records = written(spark, fixity.warc_records(table(spark, sf_dir, "pages")), "records")
    page, record = F.col("page_id"), F.col("record")
    head, tail = F.substring(record, 1, 20), F.substring(record, 22, 1 << 30)
    spoilt = F.when(page % 97 == 5, F.concat(head, F.unhex(F.lit("00")), tail))
    spoilt = spoilt.when(page % 89 == 3, F.substring(record, F.lit(1), (F.col("length") - 1).cast("int")))
    replica = records.where(page % 101 != 7).withColumn("record", spoilt.otherwise(record))
    found = fixity.audit(records, replica)
    placed = found.join(records.select("file", "offset", "length", "page_id"), ["file", "offset"])
    return placed.withColumnRenamed("offset", "record_offset")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document once the passages that smaller ids have too are gone."""
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies that every document belongs to."""
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return pages.main_text(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items, whatever numbers, units and names they were given."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says the control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat.digests(chat.windows(turns.unionByName(control)))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance for the good ones, and whether the draw keeps it."""
    docs = table(spark, sf_dir, "documents")
    good, share = importance.good_docs(table(spark, sf_dir, "labels"))
    return importance.resample(docs, good, share)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for every positive of every hundredth embedding."""
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents, some with a letter lost, and the more frequent spelling it belongs to."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every embedding, and the one that is kept."""
    return cells.near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_html_extraction": op6_html_extraction,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_source_mixing": op9_source_mixing,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_near_dedup": op13_embedding_near_dedup,
}

#: Operators 1, 9 and 10 draw by hashes that SQL lacks, 6 reads markup and 7 templates: tests compare them with plain Python.
ORACLES: dict[str, str] = {
    "op2_quality_rules": sql.OP2,
    "op3_warc_fixity": sql.OP3,
    "op4_substring_dedup": sql.OP4,
    "op5_ngram_jaccard_join": sql.OP5,
    "op8_chat_formatting": sql.OP8,
    "op11_hard_negatives": sql.OP11,
    "op12_spelling_variants": sql.OP12,
    "op13_embedding_near_dedup": sql.OP13,
}
