"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

1. Every source gets a target: a share of the whole by weight, at most ``MOST_PASSES`` times its own size; what
   is over goes to the other sources by weight.
2. The targets are apportioned as whole words: the highest quotients weight / (2k + 1) win. The words of a source are
   apportioned again to its shards, by their sizes.
3. Within a shard, documents stand in seeded order, one after the other, cut into blocks. A quota of more words than
   the shard has takes all of it and goes on; the last pass takes the blocks that come first in seeded order, the last
   one of them as far as the quota goes. So the words taken are the quota, at any size of the corpus.

A shard is a part of its source by hash, of about ``SHARD_ROWS`` documents while there are few, and at most
1 / ``MOST_SHARDS`` of the source when there are many, so no task holds a source. Only tables of one row per
source, and of one row per shard of a source, are ordered as a whole.

Highest quotients without a queue: start from the rounded shares. They miss the number of seats by at most half the
number of parties, which shifts each party by at most its share of twice that number; so few further quotients of
each party need to be ranked.

Defined cases: null and empty texts have size 0 and give nothing; a null source is a source of its own, after the
others; rows that repeat are documents of their own; without words every target is 0. Extra columns play no part.
The seed, ids and sizes fix the result, however the rows are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.components import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: Words of a block: BLOCK, or in small shards what makes SHARD_BLOCKS of them, but LEAST_BLOCK at least.
BLOCK = 128
SHARD_BLOCKS = 256
LEAST_BLOCK = 16
SHARD_ROWS = 2_000
MOST_SHARDS = 4_096
SEED = 17

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(source, source_size, n_docs, target): ``sizes`` has source, source_size and n_docs, one row per source."""
    spark = sizes.sparkSession
    # One row per source: windows over all of them hold names and numbers only.
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    sources = sizes.withColumn("_rank", rank).withColumn("weight", weight.cast("double"))
    sources = sources.withColumn("_most", (MOST_PASSES * F.col("source_size")).cast("double"))
    sources = written(spark, sources.withColumn("_ratio", F.col("_most") / F.col("weight")), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    # Sources in the order in which a rising water level reaches their limit: those before are full.
    rising = Window.orderBy("_ratio", "_rank")
    full = F.coalesce(F.sum("_most").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = sources.select("_ratio", ((total - full) / left).alias("_level"))
    x = levels.where("_level <= _ratio").agg(F.min_by("_level", "_ratio")).first()[0] or 0.0
    target = F.least(F.col("_most").cast("double"), F.col("weight") * F.lit(x))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def apportion(parties: DataFrame, group: Sequence[str], party: Sequence[str]) -> DataFrame:
    """Add ``quota`` to parties with ``weight`` and their group's ``seats``, by highest quotients weight / (2k + 1).

    Ties go to the smaller ``party``. Groups without weight get no seats.
    """
    own = Window.partitionBy(*group)
    base = parties.withColumn("_w", F.sum("weight").over(own)).withColumn("_n", F.count(F.lit(1)).over(own))
    start = F.when(F.col("_w") > 0, F.floor(F.col("weight") * F.col("seats") / F.col("_w") + 0.5)).otherwise(0)
    base = base.withColumn("_start", start.cast("bigint"))
    base = base.withColumn("_missing", F.col("seats") - F.sum("_start").over(own))
    reach = (F.ceil(F.col("weight") * F.col("_n") / F.col("_w")) + 1).cast("bigint")
    more = F.col("_missing") > 0
    steps = F.when(
        (F.col("_w") > 0) & (F.col("weight") > 0) & (F.col("_missing") != 0),
        F.sequence(F.lit(0).cast("bigint"), F.when(more, reach).otherwise(F.least(reach, F.col("_start") - 1))),
    )
    steps = F.when(~more & (F.col("_start") < 1), F.lit(None)).otherwise(steps)
    k = F.when(more, F.col("_start") + F.col("_j")).otherwise(F.col("_start") - 1 - F.col("_j"))
    quotient = F.col("weight") / (2 * k + 1)
    tried = base.select(*group, *party, "weight", "_start", "_missing", F.explode(steps).alias("_j"))
    tried = tried.withColumn("_quotient", F.when(more, -quotient).otherwise(quotient))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_quotient", *party))
    won = tried.withColumn("_place", place).where(F.col("_place") <= F.abs("_missing"))
    change = won.groupBy(*group, *party).agg(F.sum(F.signum("_missing")).cast("bigint").alias("_change"))
    quota = F.col("_start") + F.coalesce("_change", F.lit(0))
    return base.join(change, [*group, *party], "left").withColumn("quota", quota).select(*parties.columns, "quota")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of (doc_id, source, text), and the columns in ``carry``."""
    return _mixed(docs, weights, share, seed, carry).drop("spans")


def _mixed(docs: DataFrame, weights: Sequence[float], share: float, seed: int, carry: Sequence[str]) -> DataFrame:
    """The rows of mix() with the spans of words, from 0, that the last pass takes of them."""
    spark = docs.sparkSession
    sized = written(spark, docs.select("doc_id", "source", n_words("text").alias("size"), *carry), "sized")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aimed = written(spark, targets(by_source, weights, share), "targets")
    total = aimed.agg(F.sum("target")).first()[0] or 0.0
    # A source's name may be null: from here on a source is its hash, checked to be its own below.
    key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    parties = aimed.withColumn("_source", F.md5(F.to_json(key))).withColumn("weight", F.col("target"))
    # Targets are doubles: their sum may end just beside a half, and must be rounded alike in every run.
    parties = parties.withColumn("seats", F.lit(int(total + 0.501)).cast("bigint"))
    n_shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("n_docs") / SHARD_ROWS))).cast("int")
    quotas = apportion(parties, [], ["_source"]).withColumn("_shards", n_shards)
    quotas = quotas.withColumn("quota", F.least(F.col("quota"), MOST_PASSES * F.col("source_size")))
    quotas = written(spark, quotas.select("_source", "source_size", "target", "quota", "_shards"), "quotas")

    placed = sized.withColumn("_source", F.md5(F.to_json(key))).join(quotas, "_source")
    placed = placed.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id"))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("_shards")).cast("int"))
    by_draw = Window.partitionBy("_source", "_shard").orderBy("_draw", "doc_id", "size")
    end = F.sum("size").over(by_draw.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = written(spark, placed.drop("source").withColumn("_end", end), "placed")

    shards = placed.groupBy("_source", "_shard").agg(
        F.sum("size").alias("_words"), F.sum("size").cast("double").alias("weight"), F.first("quota").alias("seats")
    )
    shards = apportion(written(spark, shards, "shards"), ["_source"], ["_shard"])
    step = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.expr(f"_words div {SHARD_BLOCKS}"))).cast("bigint")
    shards = shards.where("_words > 0").withColumn("_step", step).withColumn("_passes", F.expr("quota div _words"))
    shards = written(spark, shards.withColumn("_rest", F.col("quota") % F.col("_words")), "shard-quotas")

    # A shard is one row here and thousands of blocks below: the rows are spread before they grow, by the keys of the
    # window over them, and into a fixed number of parts, as adaptive execution would merge rows that look few.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    last = F.expr("(_words - 1) div _step")
    every = shards.where("_rest > 0").repartition(n_parts, "_source", "_shard").select(
        "_source", "_shard", "_rest", "_step", "_words", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_block")
    )
    every = every.withColumn("_from", F.col("_block") * F.col("_step"))
    every = every.withColumn("_long", F.least(F.col("_step"), F.col("_words") - F.col("_from")))
    drawn = Window.partitionBy("_source", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "_source", "_shard", "_block"), "_block")
    before = F.sum("_long").over(drawn.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_long")
    chosen = every.withColumn("_open", F.col("_rest") - before).where("_open > 0")
    upto = F.col("_from") + F.least("_long", "_open")
    # The blocks grow with the corpus, while the table that they are made from looks small enough to broadcast.
    chosen = chosen.select("_source", "_shard", "_block", "_from", upto.alias("_upto")).hint("merge")

    placed = placed.join(shards.select("_source", "_shard", "_passes", "_step", "_rest"), ["_source", "_shard"], "left")
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    return _taken(written(spark, placed, "placed"), chosen, carry)


def _taken(placed: DataFrame, chosen: DataFrame, carry: Sequence[str]) -> DataFrame:
    """What each document gives: its whole passes, and the spans of it that lie in chosen blocks."""
    begin = F.col("_end") - F.col("size")
    spans = placed.where("size > 0 and _rest > 0").withColumn("_begin", begin).select(
        "_row",
        "_source",
        "_shard",
        "_end",
        "_begin",
        F.explode(F.expr("sequence(_begin div _step, (_end - 1) div _step)")).alias("_block"),
    )
    first, last = F.greatest("_begin", "_from"), F.least("_end", "_upto")
    span = F.struct((first - F.col("_begin")).alias("first"), (last - F.col("_begin")).alias("last"))
    partly = spans.join(chosen, ["_source", "_shard", "_block"]).where(first < last).groupBy("_row").agg(
        F.sum(last - first).alias("_partly"), F.sort_array(F.collect_list(span)).alias("spans")
    )
    taken = F.coalesce(F.col("_passes"), F.lit(0)) * F.col("size") + F.coalesce("_partly", F.lit(0))
    return placed.join(partly, "_row", "left").select("doc_id", "size", "source_size", "target", taken.alias("taken"), *carry, "spans")


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """The mix itself: a row of docs for every time it is taken, the last one cut to the spans of it that were drawn.

    Adds mix_copy (from 1), mix_words, mix_source_size and mix_target; ``n_chars``, where docs has it, follows the text.
    """
    spark = docs.sparkSession
    held = written(spark, docs.withColumn("_held", F.monotonically_increasing_id()), "held")
    shares = _mixed(held, weights, share, seed, ["_held"]).where("taken > 0")
    shares = shares.select("_held", F.col("size").alias("_size"), "taken", "source_size", "target", "spans")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.ceil(F.col("taken") / F.col("_size")).cast("bigint")))
    shares = shares.withColumn("mix_copy", copy)
    words = F.least(F.col("_size"), F.col("taken") - (F.col("mix_copy") - 1) * F.col("_size"))
    shares = shares.select(
        "_held",
        "mix_copy",
        words.alias("mix_words"),
        F.when(words < F.col("_size"), F.col("spans")).alias("_spans"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
    )
    out = held.join(shares, "_held")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # The pieces are an argument of the outer function, so that they are cut once and not for every span.
    drawn = F.transform(
        F.array(pieces),
        lambda p: F.flatten(F.transform("_spans", lambda s: F.slice(p, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))),
    )[0]
    # The separators before a span that begins inside the text led to a word that is not there.
    joined = F.array_join(drawn, "")
    joined = F.when(F.col("_spans")[0]["first"] > 0, F.regexp_replace(joined, r"^[\x20\x09-\x0D]+", "")).otherwise(joined)
    out = out.withColumn("_cut", F.col("_spans").isNotNull())
    out = out.withColumn("text", F.when(F.col("_cut"), joined).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop("_held", "_cut", "_spans")
