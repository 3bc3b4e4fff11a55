"""Benchmark decontamination by template windows.

Both sides are canonicalised: numbers, units after numbers and names inside sentences become typed placeholders.
Windows of the resulting templates are joined by hash, so a question that was given other numbers or names still
meets its original. Where a document and an item meet, the slots are checked: along one alignment, every value of
the item must stand for one value of the document. Only consistent alignments count.

A capitalised word at the beginning of a sentence may be a name or not, so windows are hashed with each choice of such
words as names. Digits with a point or comma inside are one number.

Every window is also joined as it stands, with letters folded, so a verbatim copy meets its item whatever stands around
it. A template with few literal words says little; such a window only meets its exact copy. Items shorter than a window
are matched as a whole.

A document holds an item when it has ``MIN_WINDOWS`` different places of the item, however often it says them. Where the
item has fewer, or fewer that other values can meet, those are enough if they are half of its windows.

The hashes of the items' windows are taken in blocks of bounded size; each block is broadcast and all documents are read
against it. A document can only hold an item of which it has one of the rarest places, all but as many as it may lack;
so documents meet items there first, and an instruction that many items begin with joins nothing.

Defined cases: null and empty texts, and items of fewer than ``LEAST_WORDS`` words, match nothing; an item that occurs
several times is matched under each of its ids; rows that repeat an id count as one document; rows with a null id come
out under null. Extra columns play no part. An empty table on either side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.components import written
from runlens.llm.words import PUNCTUATION, SPACES, Words, byte_table, mix, slices

WINDOW = 8
LEAST_WORDS = 4
LITERAL = 5
MIN_WINDOWS = 6
#: Windows of items in one broadcast block, 8 bytes each.
BLOCK = 500_000

UNITS = (
    "km m cm mm kg g mg lb lbs oz mile miles meter meters metre metres foot feet ft inch inches yard yards hour hours "
    "hr hrs minute minutes min second seconds sec day days week weeks month months year years dollar dollars euro euros "
    "pound pounds usd eur gbp cent cents percent degree degrees liter liters litre litres gallon gallons ml l mph kmh"
).split()
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million"
).split()

SEPARATORS = SPACES + PUNCTUATION
_ENDERS = byte_table(b".!?:\n\r")
_INSIDE_NUMBER = byte_table(b".,")
_DIGIT = byte_table(b"0123456789")
_UPPER = byte_table(bytes(range(65, 91)))
_HOLDERS = mix(np.arange(101, 104, dtype=np.uint64))

#: Sentence beginnings are dealt in turn to so many classes; every set of classes is tried as names.
CHOICES = 3

HITS = "id bigint, at int, n int, need int, size int, exact boolean, choice int, hash bigint, slots array<bigint>"


def _hashes(words: list[str]) -> np.ndarray:
    (found,) = slices(pa.array([" ".join(words)]), lower=True, separators=SEPARATORS)
    return np.sort(found.hashes)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _counter(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def read(column: pa.Array) -> Iterator[Words]:
    """The words of texts, with digits that a point or comma parts as one word."""
    for words in slices(column, lower=True, separators=SEPARATORS):
        part = np.zeros(len(words.row), bool)
        before = words.ends[:-1]
        part[1:] = (words.row[1:] == words.row[:-1]) & (words.starts[1:] == before + 1)
        part[1:] &= _INSIDE_NUMBER[words.data[before]] if len(before) else False
        part[1:] &= _DIGIT[words.data[before - 1]] & _DIGIT[words.data[words.starts[1:]]]
        yield words.joined(part) if part.any() else words


def template(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """0 for a literal word, 1 for a number, 2 for a unit, 3 for a name; and which literal words may be names."""
    kind, n = np.zeros(len(words.row), np.int8), len(words.row)
    if not n:
        return kind, np.zeros(0, bool)
    digits = _counter(_DIGIT[words.data])
    number = (digits[words.ends] > digits[words.starts]) | _member(words.hashes, _hashes(NUMBER_WORDS))
    follows = np.zeros(n, bool)
    follows[1:] = words.row[1:] == words.row[:-1]
    enders = _counter(_ENDERS[words.data])
    inside = follows.copy()
    inside[1:] &= enders[words.starts[1:]] == enders[words.ends[:-1]]
    second = np.minimum(words.starts + 1, len(words.data) - 1)
    capital = _UPPER[words.data[words.starts]] & ~(_UPPER[words.data[second]] & (words.ends - words.starts > 1))
    kind[inside & capital] = 3
    kind[number] = 1
    unit = follows & _member(words.hashes, _hashes(UNITS))
    unit[1:] &= number[:-1]
    kind[unit & ~number] = 2
    return kind, capital & (kind == 0)


class Windows:
    """The windows of one size in a slice, exact or as templates: first word, hash, and the values in its slots.

    A template without slots, or with few literal words, is left out: it meets no more than the exact window does.
    """

    def __init__(self, words: Words, kind: np.ndarray, size: int, exact: bool, at: np.ndarray, choice: int = 0):
        self.words, self.kind, self.size, self.exact, self.choice = words, kind, size, exact, choice
        if exact:
            self.at = at
            self.hashes = words.window_hashes(at, size, size + 1000).view(np.int64)
            return
        literal = _counter(kind == 0)
        literal = literal[at + size] - literal[at]
        self.at = at[(literal < size) & (literal >= min(LITERAL, size))]
        held = words.hashes
        words.hashes = np.where(kind > 0, _HOLDERS[np.maximum(kind, 1) - 1], held)
        self.hashes = words.window_hashes(self.at, size, size).view(np.int64)
        words.hashes = held

    def rows(self, ids: pa.Array, chosen: np.ndarray, counts: np.ndarray | None = None, need: np.ndarray | None = None) -> pa.RecordBatch:
        """Chosen windows as rows of HITS."""
        at = self.at[chosen]
        row = self.words.row[at]
        slots = [self.words.hashes[i : i + self.size][self.kind[i : i + self.size] > 0].view(np.int64) for i in at]
        n = len(at)
        columns = [
            ids.take(pa.array(self.words.first + row)),
            pa.array(at - self.words.bounds()[row], pa.int32()),
            pa.array(counts[row] if counts is not None else np.zeros(n), pa.int32()),
            pa.array(need[row] if need is not None else np.zeros(n), pa.int32()),
            pa.array(np.full(n, self.size), pa.int32()),
            pa.array(np.full(n, self.exact)),
            pa.array(np.full(n, self.choice), pa.int32()),
            pa.array(self.hashes[chosen], pa.int64()),
            pa.array(slots, pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["id", "at", "n", "need", "size", "exact", "choice", "hash", "slots"])


def windows(words: Words, size: int, rows: np.ndarray | None = None) -> Iterator[Windows]:
    """The windows of one size as they stand, and as templates with each choice of sentence beginnings as names."""
    kind, maybe = template(words)
    n = len(words.row) - size + 1
    at = np.flatnonzero(words.row[: max(n, 0)] == words.row[size - 1 :]) if n > 0 else np.empty(0, np.int64)
    at = at if rows is None else at[rows[words.row[at]]]
    yield Windows(words, kind, size, True, at)
    yield Windows(words, kind, size, False, at)
    turn = np.where(maybe, (np.cumsum(maybe) - 1) % CHOICES, -1)
    held = [_counter(turn == c) for c in range(CHOICES)]
    for choice in range(1, 1 << CHOICES):
        classes = [c for c in range(CHOICES) if choice >> c & 1]
        asked = np.logical_and.reduce([held[c][at + size] > held[c][at] for c in classes])
        if asked.any():
            yield Windows(words, np.where(np.isin(turn, classes), 3, kind), size, False, at[asked], choice)


def _needed(words: Words, size: int, counts: np.ndarray) -> np.ndarray:
    """How many windows a document must have of each row: of those that other values can meet, but half of all at least."""
    kind, maybe = template(words)
    at, _ = words.windows(size)
    literal = _counter((kind == 0) & ~maybe)
    meets = literal[at + size] - literal[at] >= min(LITERAL, size)
    open_ = np.bincount(words.row[at[meets]], minlength=words.n)
    n = np.maximum(counts - size + 1, 0)
    return np.minimum(MIN_WINDOWS, np.maximum(open_, -(-n // 2)))


def item_windows(items: DataFrame) -> DataFrame:
    """Rows of HITS for (id, text) of benchmark items; ``n`` is the number of windows the item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read(batch["text"]):
                counts = words.counts()
                sizes = np.where(counts >= LEAST_WORDS, np.minimum(counts, WINDOW), 0)
                for size in sorted(set(sizes.tolist()) - {0}):
                    need = _needed(words, size, counts)
                    for found in windows(words, size, sizes == size):
                        if len(found.at):
                            yield found.rows(batch["id"], np.ones(len(found.at), bool), counts - size + 1, need)

    return items.select(F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, HITS)


def _hits(docs: DataFrame, block: DataFrame) -> DataFrame:
    """The windows of (id, text) that a block of item windows holds."""
    by_size: dict[int, list[int]] = {}
    for r in block.select("size", "hash").distinct().collect():
        by_size.setdefault(r["size"], []).append(r["hash"])
    wanted = docs.sparkSession.sparkContext.broadcast({s: np.sort(np.array(h, np.int64)) for s, h in by_size.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in read(batch["text"]):
                for size, hashes in wanted.value.items():
                    for found in windows(words, size):
                        chosen = _member(found.hashes, hashes)
                        if chosen.any():
                            yield found.rows(batch["id"], chosen)

    return docs.mapInArrow(run, HITS)


def contaminated(docs: DataFrame, items: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, n_windows, n_item_windows, changed) of every document that holds an item.

    ``docs`` has doc_id and text, ``items`` item_id and text. ``changed`` says that numbers, units or names differ.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    windows = written(spark, item_windows(items.select(F.col("item_id").alias("id"), "text")), "item-windows")
    blocks = max(1, -(-windows.count() // block_size))
    in_block = F.pmod(F.xxhash64("size", "exact", "hash"), F.lit(blocks))
    hits = [_hits(docs, windows.where(in_block == k)).drop("n", "need") for k in range(blocks)]
    return _enough(_met(written(spark, reduce(DataFrame.union, hits), "hits"), windows))


WINDOW_KEY = ["size", "exact", "hash"]


def _rarest(windows: DataFrame) -> DataFrame:
    """The windows at each item's rarest places: whoever lacks all of them has too few of the others."""
    common = windows.groupBy(*WINDOW_KEY).agg(F.countDistinct("id").alias("items"))
    places = windows.join(common, WINDOW_KEY).groupBy("id", "at", "n", "need").agg(F.max("items").alias("items"))
    order = Window.partitionBy("id", "n", "need").orderBy("items", "at")
    rare = places.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.col("n") - F.col("need") + 1)
    return windows.join(rare.select("id", "at", "n", "need"), ["id", "at", "n", "need"], "left_semi")


def _met(hits: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of documents beside the equal windows of the items that they may hold."""
    spark = hits.sparkSession
    rare = _rarest(windows).select(*WINDOW_KEY, F.col("id").alias("item_id")).distinct()
    doc = hits.select(*WINDOW_KEY, "id").distinct()
    pairs = written(spark, doc.join(rare, WINDOW_KEY).select("id", "item_id").distinct(), "candidates")
    item = windows.select(
        *WINDOW_KEY,
        F.col("id").alias("item_id"),
        F.col("at").alias("item_at"),
        F.col("n").alias("n_item_windows"),
        F.col("choice").alias("item_choice"),
        "need",
        F.col("slots").alias("item"),
    )
    wanted = pairs.join(item, "item_id")
    same = [F.col("w.id").eqNullSafe(F.col("h.id")), *(F.col(f"w.{k}") == F.col(f"h.{k}") for k in WINDOW_KEY)]
    met = hits.alias("h").join(wanted.alias("w"), reduce(Column.__and__, same))
    met = met.select("h.id", "h.at", "h.choice", "h.slots", "w.exact", *(f"w.{c}" for c in ("item_id", "item_at", "n_item_windows", "item_choice", "need", "item")))
    return met.withColumn("shift", F.col("at") - F.col("item_at"))


def _enough(met: DataFrame) -> DataFrame:
    """Documents and items with enough windows on consistent alignments."""
    # An exact window has the item's values, whatever kinds its words have in the document.
    pair = F.arrays_zip("item", F.when(F.col("exact"), F.col("item")).otherwise(F.col("slots")).alias("doc"))
    # Names at the beginning of sentences may only add: an alignment that they make inconsistent is judged without them.
    plain = (F.col("choice") == 0) & (F.col("item_choice") == 0)
    aligned = met.groupBy(F.col("id").alias("doc_id"), "item_id", "n_item_windows", "need", "shift").agg(
        F.collect_set("item_at").alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"),
        F.collect_set(F.when(plain, F.col("item_at"))).alias("places_plain"),
        F.array_distinct(F.flatten(F.collect_set(F.when(plain, pair)))).alias("pairs_plain"),
    )
    consistent = F.size(F.array_distinct(F.col("pairs.item"))) == F.size("pairs")
    aligned = aligned.withColumn("places", F.when(consistent, F.col("places")).otherwise(F.col("places_plain")))
    aligned = aligned.withColumn("pairs", F.when(consistent, F.col("pairs")).otherwise(F.col("pairs_plain")))
    changed = F.exists("pairs", lambda p: ~p["item"].eqNullSafe(p["doc"]))
    # A place of the item counts once, however often the document has it.
    placed = aligned.where(consistent).withColumn("changed", changed).withColumn("place", F.explode("places"))
    placed = placed.groupBy("doc_id", "item_id", "n_item_windows", "need", "place").agg(F.bool_or("changed").alias("changed"))
    held = placed.groupBy("doc_id", "item_id", "n_item_windows", "need").agg(F.count(F.lit(1)).alias("n_windows"), F.bool_or("changed").alias("changed"))
    return held.where("n_windows >= need").select("doc_id", "item_id", "n_windows", "n_item_windows", "changed")
