"""Which keys occur under more than one owner, found in one shuffle of arrays.

Keys come as arrays per batch of documents. A batch first settles what it can by itself: of a key that several of
its owners hold, only the smallest owner's entries travel, so a key that a third of all documents hold sends one
owner per batch, not one per document. What travels is dealt by the key's leading bits, as arrays of the key's
rest, its owners and places, to groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import mix

#: About so many entries meet in one group.
GROUP_ENTRIES = 250_000
LEAST_BITS = 6
MOST_BITS = 24

ENTRIES = "bucket int, keys array<bigint>, owners array<bigint>, places array<int>"
NARROW = "bucket int, keys array<int>, owners array<bigint>, places array<int>"
FOUND = "part int, owners array<bigint>, places array<int>"

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def bits_for(entries: float) -> int:
    """How many leading bits of a key name its group."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(entries, 1) / GROUP_ENTRIES)))))


def prime_from(n: int) -> int:
    """The first prime from ``n`` on: ids in steps of any other number spread evenly over so many parts."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def by_key(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, owner) and, in that order, the smallest and the greatest owner of each entry's key."""
    order = np.lexsort((owners, keys))
    k, o = keys[order], owners[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(k)) - 1
    return order, o[first][group] if len(k) else o, o[last][group] if len(k) else o


def shared(owner: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Entries whose key has more than one owner."""
    return least != most


def later(owner: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Entries whose key a smaller owner has too."""
    return owner > least


Rule = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _lists(cuts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))


def _cut(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by name, the names in it, and where each name's run begins, with the end."""
    order = np.argsort(names, kind="stable")
    found, first = np.unique(names[order], return_index=True)
    return order, found, np.append(first, len(names))


def found_batch(owners: np.ndarray, places: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries as one row per part of their owners."""
    order, names, cuts = _cut(owners % parts)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.int32()), _lists(cuts, owners[order], pa.int64()), _lists(cuts, places[order], pa.int32())],
        ["part", "owners", "places"],
    )


def known(entries: Entries, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Owners and places of the entries that a batch settles by itself."""
    keys, owners, places = entries
    order, least, most = by_key(keys, owners)
    keep = rule(owners[order], least, most)
    return owners[order][keep], places[order][keep]


def sent_batch(entries: Entries, bits: int, names: np.ndarray | None = None) -> pa.RecordBatch:
    """What a batch sends, as one row per bucket.

    Without ``names`` the buckets are the key's leading bits and 32 of the following bits travel: enough where
    a later step checks what is found. With them, the whole key travels, and key and name must both agree.
    """
    keys, owners, places = entries
    order, least, _ = by_key(keys, owners)
    order = order[owners[order] == least]
    keys, owners, places = keys[order], owners[order], places[order]
    buckets = (keys if names is None else names[order]) >> np.uint64(64 - bits)
    order, found, cuts = _cut(buckets.astype(np.int64))
    keys = keys[order]
    if names is None:
        keys = (keys >> np.uint64(32 - bits)).astype(np.uint32).view(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found, pa.int32()),
            _lists(cuts, keys.view(np.int64) if names is not None else keys, pa.int64() if names is not None else pa.int32()),
            _lists(cuts, owners[order], pa.int64()),
            _lists(cuts, places[order], pa.from_numpy_dtype(places.dtype)),
        ],
        ["bucket", "keys", "owners", "places"],
    )


def flat(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a column of lists, in order."""
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]
    return np.concatenate(chunks) if chunks else np.empty(0, np.int64)


def meet(sent: DataFrame, rule: Rule, parts: int, bits: int) -> DataFrame:
    """Apply the rule to every key among all owners that were sent: rows of FOUND.

    Buckets from ``1 << bits`` on hold what batches settled by themselves, one for each part; it passes through.
    """

    def settle(group: pa.Table) -> pa.Table:
        bucket, owners, places = group["bucket"][0].as_py(), flat(group, "owners"), flat(group, "places")
        if bucket >> bits == 0:
            owners, places = known((flat(group, "keys"), owners, places), rule)
        return pa.Table.from_batches([found_batch(owners, places, parts)])

    return sent.groupBy("bucket").applyInArrow(settle, FOUND)


def settled_batch(found: pa.RecordBatch, bits: int, keys: pa.DataType) -> pa.RecordBatch:
    """A batch of FOUND as rows that ``meet`` passes through."""
    bucket = pc.add(found["part"], pa.scalar(1 << bits, pa.int32()))
    none = pa.nulls(len(found), pa.list_(keys))
    return pa.RecordBatch.from_arrays([bucket, none, found["owners"], found["places"]], ["bucket", "keys", "owners", "places"])


def has_bits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which bits of a bitmap's bytes are set."""
    return (data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


class Bitmap:
    """A set of numbers by hash, of fixed size: it may hold more than was put in, never less."""

    def __init__(self, bits: int, data: bytes):
        self.bits, self.data = bits, np.frombuffer(data, np.uint8)

    @staticmethod
    def places(values: np.ndarray, bits: int) -> np.ndarray:
        """The bit of each number."""
        return mix(values.view(np.uint64)) >> np.uint64(64 - bits)

    def has(self, values: np.ndarray) -> np.ndarray:
        return has_bits(self.data, self.places(values, self.bits))


#: A bitmap has at most 16 MB.
LEAST_BITMAP, MOST_BITMAP = 20, 27


def bitmap_bits(values: float) -> int:
    return int(min(MOST_BITMAP, max(LEAST_BITMAP, np.ceil(np.log2(max(values, 1))) + 4)))


def bits_set(frame: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> DataFrame:
    """The words of a bitmap, and their bits, that each task sets at the ``places`` of its batches."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            at = places(batch)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        words = own.view(np.int64)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(words[some])], ["word", "bits"])

    return frame.mapInArrow(fill, "word int, bits bigint")


def union_of_bits(frame: DataFrame, places: Callable[[pa.RecordBatch], np.ndarray], bits: int) -> np.ndarray:
    """The bytes of a bitmap in which each batch sets the bits at its ``places``.

    Every task sends the words that it set, equal words are joined in the shuffle, and what reaches the driver is
    never more than the bitmap.
    """
    joined = bits_set(frame, places, bits).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << bits >> 6, np.int64)
    out[joined["word"].to_numpy()] = joined["bits"].to_numpy()
    return out.view(np.uint8)


def owners_of(found: DataFrame) -> DataFrame:
    """The owners in rows of FOUND, all entries of one owner in one task.

    Entries are found by key, so most tasks hold some of almost every owner. A bitmap of them as they lie sends each
    owner's word once a task; of these it sends no more words than there are owners, however many tasks there are.
    """
    return found.select("part", "owners").repartition("part").select("owners")


def bitmap_of(frame: DataFrame, bits: int) -> Bitmap:
    """A bitmap of the first column, numbers or arrays of them."""

    def places(batch: pa.RecordBatch) -> np.ndarray:
        column = batch.column(0)
        column = column.flatten() if pa.types.is_list(column.type) else column
        return Bitmap.places(column.to_numpy(zero_copy_only=False).astype(np.int64), bits)

    return Bitmap(bits, union_of_bits(frame, places, bits).tobytes())


def among(frame: DataFrame, bitmap: Bitmap, inside: bool = True, name: str = "doc_id") -> DataFrame:
    """The rows whose ``name`` is in the bitmap, or those whose ``name`` is not."""
    shared_map = frame.sparkSession.sparkContext.broadcast((bitmap.bits, bitmap.data.tobytes()))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Bitmap(*shared_map.value)
        for batch in batches:
            yield batch.filter(pa.array(marks.has(batch[name].to_numpy(zero_copy_only=False)) == inside))

    return frame.mapInArrow(pick, frame.schema)


def concatenated(chunks: list[Entries]) -> Entries:
    if not chunks:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
    return tuple(np.concatenate(x) for x in zip(*chunks, strict=True))


def gathered(chunks: Iterator[Entries], most: int = 500_000) -> Iterator[Entries]:
    """Entries of several slices put together, up to about ``most``."""
    kept, n = [], 0
    for chunk in chunks:
        kept.append(chunk)
        n += len(chunk[0])
        if n >= most:
            yield concatenated(kept)
            kept, n = [], 0
    if n:
        yield concatenated(kept)


def by_part(owners: DataFrame, name: str, parts: int) -> DataFrame:
    return owners.withColumn("_part", F.pmod(F.col(name), F.lit(parts)).cast("int"))
