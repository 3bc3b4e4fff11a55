"""Quality selection by importance resampling with hashed n-gram models.

Two generative models of bags of hashed words and word pairs are counted: one of the target (documents labelled good),
one of all raw text. A document's importance is the log ratio of its likelihoods under the two, per n-gram and scaled
to ``LENGTH`` n-grams so that length alone does not decide. Adding seeded Gumbel noise and keeping the k highest keys
draws k documents without replacement in proportion to their importance.

Both models are counted in one pass where the texts are read, and no text moves. The raw model covers every row, and its buckets
grow with the documents, from 2^16 to 2^20, so that rare n-grams keep buckets of their own. The target model is fitted on
all documents labelled good, or on about ``GOOD_DOCS`` of them by hash of the id; their ids are broadcast, 8 MB at most.
The k-th highest key is found by counting keys in ever finer bins, not by sorting.

Defined cases: null and empty texts have importance 0 and take part with their noise; rows that repeat an id draw the
same noise; ties go to smaller ids, and rows that tie in both are all kept or all left; without labelled rows the target is the raw text and
the draw is even. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.components import written
from runlens.llm.words import slices

#: A bucket for so many documents, within bounds.
LEAST_BUCKETS, MOST_BUCKETS, DOCS_A_BUCKET = 1 << 16, 1 << 20, 64
#: The target is fitted on about so many good documents at most.
GOOD_DOCS = 1 << 20
LENGTH = 200.0
SEED = 23
SMOOTHING = 1.0
_BINS = 1 << 12


def buckets_for(n_docs: int) -> int:
    """How many buckets the models of so many documents have: a power of two."""
    return 1 << int(np.ceil(np.log2(min(MOST_BUCKETS, max(LEAST_BUCKETS, n_docs / DOCS_A_BUCKET)))))


def _grams(words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word and pair of words."""
    at, pairs = words.windows(2, 5)
    rows = np.concatenate([words.row, words.row[at]])
    hashes = np.concatenate([words.hashes, pairs])
    return rows, (hashes >> np.uint64(65 - buckets.bit_length())).astype(np.int64)


def models(docs: DataFrame, buckets: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the documents whose id is in ``good`` (sorted), and in all of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros((2, buckets), np.int64), shared.value
        for batch in batches:
            named = batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            own = pc.fill_null(batch["doc_id"], 0).to_numpy()
            wanted = named & (ids[np.minimum(np.searchsorted(ids, own), len(ids) - 1)] == own) if len(ids) else named & False
            for words in slices(batch["text"], lower=True):
                rows, found = _grams(words, buckets)
                total[1] += np.bincount(found, minlength=buckets)
                total[0] += np.bincount(found[wanted[words.first + rows]], minlength=buckets)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(t[some]) for t in total)], ["bucket", "good", "n"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = docs.mapInArrow(count, "bucket int, good bigint, n bigint").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow()
    out = np.zeros((2, buckets))
    out[:, counts["bucket"].to_numpy()] = counts["good"].to_numpy(), counts["n"].to_numpy()
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """The log of the models' ratio for each bucket, smoothed by the raw model."""
    if not target.sum() or not raw.sum():
        return np.zeros(len(raw))
    prior = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    good = (target + SMOOTHING * len(raw) * prior) / (target.sum() + SMOOTHING * len(raw))
    return np.log(good) - np.log(prior)


def importance(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight) of every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch["text"], lower=True):
                rows, buckets = _grams(words, len(shared.value))
                n = np.bincount(rows, minlength=words.n)
                total = np.bincount(rows, weights=shared.value[buckets], minlength=words.n)
                weight = total / np.maximum(n, 1) * np.minimum(n, LENGTH)
                columns = [batch["doc_id"].slice(words.first, words.n), pa.array(n.astype(np.int64)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_grams", "log_weight"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n_grams bigint, log_weight double")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise that the seed and the id fix."""
    bits = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)).cast("double")
    return -F.log(-F.log((bits + 0.5) / F.lit(float(1 << 52))))


def threshold(keys: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th highest key and, among rows with that key, how many are in: by counts in ever finer bins."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return None
    above, left = 0, keys
    while True:
        width = (high - low) / _BINS
        if width <= 0 or low + width == low:
            at = left.where(F.col("key") >= low).agg(F.max("key")).first()[0]
            return at, k - above
        place = F.least(F.floor((F.col("key") - low) / width), F.lit(_BINS - 1)).cast("int")
        bins = left.withColumn("bin", place).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if above + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            above += r["n"]
        else:
            return low, 0
        if low == high:
            return low, k - above
        left = keys.where((F.col("key") >= low) & (F.col("key") <= high))


def resample(docs: DataFrame, good: np.ndarray, share: float, seed: int = SEED) -> DataFrame:
    """(doc_id, n_grams, log_weight, key, kept): ``share`` of docs are kept. ``good`` has the target's sorted ids."""
    ratio = log_ratio(*models(docs, buckets_for(docs.count()), good))
    scored = importance(docs, ratio).withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id"), seed))
    scored = written(docs.sparkSession, scored, "importance")
    k = round(share * scored.count())
    found = threshold(scored.select("key"), k)
    if found is None:
        return scored.withColumn("kept", F.lit(False))
    at, ties = found
    tied = scored.where(F.col("key") == at).select("doc_id")
    if tied.count() <= ties:
        return scored.withColumn("kept", F.col("key") >= at)
    last = tied.orderBy(F.col("doc_id").asc_nulls_last()).limit(ties).agg(F.max("doc_id")).first()[0]
    first = (F.col("key") == at) & (F.col("doc_id") <= (-1 if last is None else last))
    return scored.withColumn("kept", (F.col("key") > at) | F.coalesce(first, F.lit(False)))


def good_docs(labels: DataFrame, most: int = GOOD_DOCS) -> tuple[np.ndarray, float]:
    """The sorted ids of about ``most`` documents labelled good, or of all, and the share of good ones (1 without labels)."""
    ids = labels.where("doc_id is not null and quality is not null")
    ids = ids.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("good"))
    share, n = ids.agg(F.avg("good"), F.sum("good")).first()
    chosen = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 32)) < round(min(1.0, most / max(1, n or 0)) * (1 << 32))
    found = ids.where("good = 1").where(chosen).select("doc_id").toArrow()
    return np.sort(found["doc_id"].to_numpy()), 1.0 if share is None else share
