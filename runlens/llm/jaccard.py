"""Size-aware heavy-light similarity join on sets of word shingles.

Two texts link when the Jaccard similarity of their sets reaches the threshold. Small sets and large sets are joined
in different ways:

* Small sets enumerate their subsets of the fixed size that a link of two such sizes must share, and meet by
  equality. Sharing one is the proof of a link, so the members of a subset link to its smallest, without a pair more.
* Large sets scan inverted lists. A set is listed under its rarest shingles only, just enough that two linked sets
  must share one. Lists with one set in them end in their bucket. The others link in two passes: first every set
  is compared with one head of each of its lists, and what links becomes one component; then only sets of one
  list that are still in different components are compared. Both leave out a pair when too few elements follow the shared one
  in their orders. No link is lost: a linked pair is in one component already, or meets under the first element it shares.

The boundary between small and large is the size at which subsets become dearer than lists, by the counts of both.

Before whole texts travel, a pair passes a bound: each set has a bitmap of about as many bits as elements, in which every
element flips one bit. Two sets differ in as many elements at least as their bitmaps differ in bits, so a pair whose bitmaps are too
far apart cannot link.

Sets that are equal become one class before any of this, so exact copies cost nothing further. Frequent shingles
are found by counts over all documents and marked in a bitmap sized by their number; they come last in the order that says
which shingles list a set. The marks steer the work only: any order gives the same links.

Defined cases: null and empty texts have an empty set and no links; texts with fewer words than a shingle have their
whole sequence as the one element; rows with a null id are a component of their own (null); rows that repeat an id
and its text all get the same result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm import repeats
from runlens.llm.components import components, written
from runlens.llm.words import Words, keys, mix, slices, texts_of

SHINGLE = 5
PERCENT = 80
#: Sets up to this size may be small; the boundary is chosen below it.
MOST_SMALL = 12
#: Bits of the bitmap that marks frequent shingles, from 1 to 16 MB: eight for each shingle and more.
LEAST_MARKS, MOST_MARKS = 23, 27
#: A shingle is frequent from so many documents on.
FREQUENT = 64
#: Shingles are counted so many at a time; counts below the least are not sent on.
COUNTED = 2_000_000
LEAST_COUNT = 3


NARROW = "bucket int, keys array<int>, owners array<bigint>, places array<bigint>"


def overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """What sets of these sizes must share to link."""
    return -(-percent * (s + t) // (100 + percent))


def prefix(size, percent: int = PERCENT):
    """Under how many of its elements a set is listed."""
    return size - -(-percent * size // 100) + 1


class Sets:
    """The distinct shingles of each row of a slice, by row."""

    def __init__(self, words: Words, size: int = SHINGLE):
        counts, bounds = words.counts(), words.bounds()
        at, hashes = words.windows(size)
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = mix(words.sequence_hashes()[short] + np.uint64(1))
        rows, values = np.concatenate([words.row[at], short]), np.concatenate([hashes, whole])
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        self.rows, self.values, self.n = rows[new], values[new], words.n
        self.sizes = np.bincount(self.rows, minlength=words.n).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.first = words.first

    def signature(self, seed: int) -> np.ndarray:
        """A hash of each row's set."""
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(self.values ^ keys(1, seed)), dtype=np.uint64)])
        return mix(sums[self.bounds[1:]] - sums[self.bounds[:-1]] + self.sizes.astype(np.uint64))


    def flips(self) -> list[bytes]:
        """Each row's bitmap: its elements flip the bits that their leading bits name."""
        bits = np.maximum(6, np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(np.int64))
        ends = np.cumsum(1 << bits)
        hashes = mix(self.values ^ keys(1, 3)) >> (64 - bits[self.rows]).astype(np.uint64)
        flipped = np.bincount((ends - (1 << bits))[self.rows] + hashes.astype(np.int64), minlength=int(ends[-1])) & 1
        packed = np.packbits(flipped.astype(np.uint8)).tobytes()
        return [packed[end - (1 << k) >> 3 : end >> 3] for end, k in zip(ends.tolist(), bits.tolist(), strict=True)]


def may_link(flips_a: bytes, size_a: int, flips_b: bytes, size_b: int, percent: int = PERCENT) -> bool:
    """Whether the bitmaps of two sets leave room for a link."""
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in (flips_a, flips_b))
    while len(a) > len(b):
        a = a[::2] ^ a[1::2]
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return (size_a + size_b - int((a ^ b).sum())) // 2 >= overlap(size_a, size_b, percent)


def _frequent(docs: DataFrame, size: int, frequent: int) -> tuple[int, np.ndarray]:
    """How many leading bits of a shingle name its mark, and the marks of the shingles that many documents hold."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = ((Sets(w, size).values,) for batch in batches for w in slices(batch["text"], lower=True))
        for (values,) in repeats.gathered(sets, COUNTED):
            found, n = np.unique(values, return_counts=True)
            often = n >= LEAST_COUNT
            columns = [pa.array(found[often].view(np.int64)), pa.array(n[often], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "n"])

    counted = docs.mapInArrow(count, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = written(docs.sparkSession, counted.where(F.col("n") >= frequent).select("shingle"), "frequent")
    bits = int(min(MOST_MARKS, max(LEAST_MARKS, np.ceil(np.log2(found.count() + 1)) + 3)))
    return bits, repeats.union_of_bits(found, lambda batch: batch["shingle"].to_numpy().view(np.uint64) >> np.uint64(64 - bits), bits)


def _signed(docs: DataFrame, size: int, most_small: int) -> DataFrame:
    """Each document's set as two hashes and a size; small sets with their elements."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"]
            for words in slices(batch["text"], lower=True):
                sets = Sets(words, size)
                small = (sets.sizes > 0) & (sets.sizes <= most_small)
                elements = [
                    sets.values[sets.bounds[r] : sets.bounds[r + 1]].view(np.int64) if small[r] else None for r in range(sets.n)
                ]
                columns = [
                    ids.slice(words.first, words.n),
                    pa.array(sets.signature(1).view(np.int64)),
                    pa.array(sets.signature(2).view(np.int64)),
                    pa.array(sets.sizes),
                    pa.array(elements, pa.list_(pa.int64())),
                    pa.array(sets.flips(), pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "sign", "sign2", "size", "elements", "flips"])

    schema = "doc_id bigint, sign bigint, sign2 bigint, size bigint, elements array<bigint>, flips binary"
    return docs.mapInArrow(sign, schema)


def _partners(s: int, most: int, percent: int) -> list[int]:
    return [t for t in range(1, most + 1) if percent * max(s, t) <= 100 * min(s, t)]


def boundary(small: DataFrame, most: int = MOST_SMALL, percent: int = PERCENT) -> int:
    """The size up to which enumerating subsets costs less than scanning lists; ``small`` has size and elements."""
    length = F.expr(f"cast(size - ({percent} * size + 99) div 100 + 1 as int)")
    listed = small.select("size", F.explode(F.slice("elements", F.lit(1), length)).alias("e"))
    lists = listed.groupBy("e", "size").count()
    length = lists.groupBy("e").agg(F.sum("count").alias("length"))
    scans = lists.join(length, "e").groupBy("size").agg(F.sum(F.col("count") * F.col("length")).alias("cost"))
    scan = {r["size"]: r["cost"] for r in scans.collect()}
    sets = {r["size"]: r["count"] for r in small.groupBy("size").count().collect()}

    def cost(x: int) -> int:
        subsets = sum(n * sum(comb(s, overlap(s, t, percent)) for t in _partners(s, x, percent)) for s, n in sets.items() if s <= x)
        return subsets + sum(n for s, n in scan.items() if s > x)

    return min(range(most + 1), key=cost)


def _subset_links(small: DataFrame, most: int, percent: int) -> DataFrame:
    """Links among small sets: everything that shares a subset of the size that its two sizes ask for."""

    def enumerate_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = keys(most, 7)
        for batch in batches:
            rows = []
            for node, size, elements in zip(batch["node"], batch["size"], batch["elements"], strict=True):
                values = np.sort(np.asarray(elements, np.int64).view(np.uint64))
                for t in _partners(size, most, percent):
                    c = overlap(size, t, percent)
                    picks = np.array(list(combinations(range(size), c)), np.int64).reshape(-1, c)
                    hashes = mix((values[picks] * weights[:c]).sum(axis=1, dtype=np.uint64)).view(np.int64)
                    rows += [(min(size, t), max(size, t), h, size, node) for h in hashes.tolist()]
            yield pd.DataFrame(rows, columns=["low", "high", "subset", "size", "node"])

    subsets = small.select("node", "size", "elements").mapInPandas(
        enumerate_, "low int, high int, subset bigint, size bigint, node bigint"
    )
    subsets = written(small.sparkSession, subsets, "subsets")
    first = subsets.groupBy("low", "high", "subset").agg(F.min(F.struct("size", "node")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1 and first.size = low").select("low", "high", "subset", F.col("first.node").alias("b"))
    first = written(small.sparkSession, first, "subset-heads")
    return subsets.join(first, ["low", "high", "subset"]).select(F.col("node").alias("a"), "b").where("a <> b").distinct()


def _lists(docs: DataFrame, bitmap, mark_bits: int, bits: int, least: int, size: int, percent: int) -> DataFrame:
    """(list, sign, size, place) of the sets of at least ``least`` elements in lists with more than one set."""

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[repeats.Entries]:
        marks = np.frombuffer(bitmap.value, np.uint8)

        def entries(words: Words) -> repeats.Entries:
            sets = Sets(words, size)
            frequent = repeats.has_bits(marks, sets.values >> np.uint64(64 - mark_bits))
            order = np.lexsort((sets.values, frequent, sets.rows))
            rows = sets.rows[order]
            place = np.arange(len(rows)) - sets.bounds[rows]
            listed = (place < prefix(sets.sizes[rows], percent)) & (sets.sizes[rows] >= least)
            rows, values = rows[listed], sets.values[order][listed]
            # Size of the set and place of the element in its order, in one number.
            return mix(values), sets.signature(1).view(np.int64)[rows], sets.sizes[rows] << 32 | place[listed]

        chunks = (entries(words) for batch in batches for words in slices(batch["text"], lower=True))
        return map(_unique, repeats.gathered(chunks))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in batches_of(batches):
            yield repeats.sent_batch(entries, bits)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys_, owners, places in batches_of(batches):
            yield _listed(keys_ >> np.uint64(32 - bits), owners, places)

    def meet(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        short = repeats.flat(group, "keys").astype(np.int32).view(np.uint32).astype(np.uint64)
        keys_ = (np.uint64(bucket) << np.uint64(32)) | short
        return pa.Table.from_batches([_listed(keys_, repeats.flat(group, "owners"), repeats.flat(group, "places"))])

    schema = "list bigint, sign bigint, size bigint, place bigint"
    sent = docs.mapInArrow(send, NARROW).groupBy("bucket").applyInArrow(meet, schema)
    return sent.union(docs.mapInArrow(settle, schema))


def _unique(entries: repeats.Entries) -> repeats.Entries:
    """Copies of a set list it once per batch."""
    keys_, owners, places = entries
    order = np.lexsort((owners, keys_))
    keys_, owners, places = keys_[order], owners[order], places[order]
    new = np.ones(len(keys_), bool)
    new[1:] = (keys_[1:] != keys_[:-1]) | (owners[1:] != owners[:-1])
    return keys_[new], owners[new], places[new]


def _listed(keys_: np.ndarray, owners: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """The entries of keys with several owners, one row each."""
    order, least, most = repeats.by_key(keys_, owners)
    order = order[least != most]
    places = places[order]
    columns = [keys_[order].view(np.int64), owners[order], places >> 32, places & 0xFFFFFFFF]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["list", "sign", "size", "place"])


def _chunks(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows whose two texts have about ``most`` bytes."""
    size = sum(np.diff(np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1]) for t in map(texts_of, (batch["text_a"], batch["text_b"])))
    total, first = np.cumsum(size), 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + most, "right")))
        yield first, last
        first = last


def _close(pairs: DataFrame, flips: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their bitmaps leave room for."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = (batch[c].to_pylist() for c in ("flips_a", "size_a", "flips_b", "size_b"))
            keep = pa.array([may_link(*pair, percent) for pair in zip(*sides, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[c].filter(keep) for c in "ab"], ["a", "b"])

    a, b = (flips.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("flips").alias(f"flips_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").mapInArrow(bound, "a bigint, b bigint")


def _linked(pairs: DataFrame, flips: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    spark = pairs.sparkSession
    pairs = written(spark, _close(pairs, flips, percent), "close")
    ends = pairs.select("a").union(pairs.select("b"))
    marks = repeats.bitmap_of(ends, repeats.bitmap_bits(2 * pairs.count()))
    texts = repeats.among(docs.where("doc_id is not null"), marks).select(F.col("doc_id").alias("node"), "text")
    texts = written(spark, texts.dropDuplicates(["node"]), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in _chunks(batch):
                sides = []
                for name in ("text_a", "text_b"):
                    (words,) = slices(batch[name].slice(first, last - first), lower=True, most=1 << 62)
                    sides.append(Sets(words, size))
                rows = np.concatenate([s.rows for s in sides])
                values = np.concatenate([s.values for s in sides])
                order = np.lexsort((values, rows))
                rows, values = rows[order], values[order]
                both = np.bincount(rows[1:][(rows[1:] == rows[:-1]) & (values[1:] == values[:-1])], minlength=last - first)
                link = 100 * both >= percent * (sides[0].sizes + sides[1].sizes - both)
                link = pa.array(link & (both > 0))
                yield pa.RecordBatch.from_arrays([batch[c].slice(first, last - first).filter(link) for c in "ab"], ["a", "b"])

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a bigint, b bigint")


def jaccard_join(
    docs: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    most_small: int = MOST_SMALL,
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = written(spark, _signed(docs, shingle, most_small), "signed")
    own = signed.where("doc_id is not null and size > 0")
    same = ["sign", "sign2", "size"]
    members = written(spark, own.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    small = own.where("elements is not null").groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("elements").alias("elements"))
    small = written(spark, small.select("node", "size", "elements"), "small")
    limit = boundary(small, most_small, percent)
    links = [_subset_links(small.where(F.col("size") <= limit), limit, percent)] if limit else []

    elements = own.agg(F.sum("size").alias("n")).first()["n"] or 0
    text = docs.where("doc_id is not null").select("text")
    mark_bits, marks = _frequent(text, shingle, frequent)
    bitmap = spark.sparkContext.broadcast(marks.tobytes())
    least = -(-percent * (limit + 1) // 100)
    bits = repeats.bits_for(elements * (100 - percent) / 100)
    lists = _lists(text, bitmap, mark_bits, bits, least, shingle, percent).distinct()
    lists = lists.join(members.select("sign", "size", "node"), ["sign", "size"]).select("list", "node", "size", "place")
    lists = written(spark, lists, "lists")
    flips = signed.select(F.col("doc_id").alias("node"), "size", "flips")
    flips = flips.join(lists.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    flips = written(spark, flips, "flips")

    # What two sets can still share from this element of their orders on must do for a link.
    near = (
        f"{percent} * greatest(size, other) <= 100 * least(size, other) and greatest(size, other) > {limit} and "
        f"(100 + {percent}) * least(size - place, other - other_place) >= {percent} * (size + other)"
    )
    # A list's head is the set that shares the longest lists: of a group of near copies, the one they come from.
    length = written(spark, lists.groupBy("list").agg(F.count(F.lit(1)).alias("length")), "lengths")
    weight = lists.join(length, "list").groupBy("node").agg(F.sum("length").alias("weight"))
    weight = written(spark, weight, "weights")
    ranked = lists.join(weight, "node").select("list", F.struct("weight", F.negative("size"), "node", "size", "place").alias("head"))
    heads = written(spark, ranked.groupBy("list").agg(F.max("head").alias("head")), "heads")
    other = [F.col("head.node").alias("b"), F.col("head.size").alias("other"), F.col("head.place").alias("other_place")]
    first = lists.join(heads, "list").select("node", "size", "place", *other).where("node <> b").where(near)
    first = first.select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b"))
    first = written(spark, first.distinct(), "pairs")
    links.append(_linked(first, flips, docs, shingle, percent))
    found = links[0] if len(links) == 1 else links[0].union(links[1])
    found = written(spark, found, "links")
    grouped = written(spark, components(found), "components")

    now = lists.join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    now = written(spark, now.select("list", "node", "size", "place", "component"), "lists")
    mixed = now.groupBy("list").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = now.join(written(spark, mixed.select("list"), "mixed"), "list", "left_semi")
    mixed = written(spark, mixed, "mixed-lists")
    renamed = {"node": "b", "size": "other", "place": "other_place", "component": "other_component"}
    other = mixed.withColumnsRenamed(renamed)
    rest = mixed.join(other, "list").where("node > b and component <> other_component").where(near)
    rest = rest.select(F.col("node").alias("a"), "b").distinct().join(first, ["a", "b"], "left_anti")
    more = written(spark, _linked(written(spark, rest, "pairs"), flips, docs, shingle, percent), "links")
    if not more.isEmpty():
        grouped = written(spark, components(found.union(more)), "components")

    classes = members.join(grouped, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
    placed = signed.select("doc_id", *same).join(classes, same, "left")
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("size").alias("n_shingles"), own_id.alias("component_id"))
