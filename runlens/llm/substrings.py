"""Substring deduplication by difference-cover anchors.

A passage of ``window`` words that also starts in a document with a smaller id is removed there, word by word.
Hashing every window of a corpus would shuffle one entry per word. Instead only short anchors are hashed, and only
at the positions whose remainder by a period lies in a difference cover: for any two positions some common shift
brings both into the cover, so two equal windows share an anchor at the same offset. Anchors that more than one
document holds then extend: the windows around them, and no others, are hashed whole and compared.

1. Anchors of all documents meet by hash; a document learns which of its anchors others have too.
2. Texts that hold a shared anchor meet their anchors by id and hash the windows around them.
3. Those windows meet by hash; a document learns which of them a smaller id has too.
4. Texts that hold such a window meet them by id and drop their words. All others are done where they are.

A bitmap of fixed size says which texts need to travel in steps 2 and 4; one that travels in vain only costs its way.

Anchors are matched on 32 bits of hash within a group of about 250,000; a false match only costs a comparison.
Windows are matched on 64 bits within groups that a second hash names.

Defined cases: null and empty texts have no words; texts with fewer words than a window keep all; a document's
own repeats stay; a row with a null id is kept whole and compared with nothing; rows that repeat an id and its text
all get the same result. Extra columns are carried on when asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from runlens.llm import repeats
from runlens.llm.components import written
from runlens.llm.words import Words, slices

WINDOW = 13
PERIOD = 7
#: About so many bytes of text meet in one group.
PART_BYTES = 4 << 20
#: A word takes about so many bytes: only used to choose how many groups there are.
WORD_BYTES = 6

_SENT = pa.schema(
    [
        ("bucket", pa.int32()),
        ("keys", pa.list_(pa.int64())),
        ("owners", pa.list_(pa.int64())),
        ("places", pa.list_(pa.int32())),
    ]
)

RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def difference_cover(period: int) -> list[int]:
    """Remainders such that every difference by the period occurs between two of them."""
    cover, missing = [0], set(range(1, period))
    while missing:
        gains = {c: {(c - x) % period for x in cover} | {(x - c) % period for x in cover} for c in range(1, period)}
        best = max(gains, key=lambda c: (len(gains[c] & missing), -c))
        cover.append(best)
        missing -= gains[best]
    return sorted(cover)


def _places(words: Words) -> np.ndarray:
    """Each word's place in its document."""
    return np.arange(len(words.row)) - words.bounds()[words.row]


def _anchors(ids: np.ndarray, words: Words, window: int, period: int) -> repeats.Entries:
    """Hash, id and place of the anchors at cover positions of texts with a window at least."""
    size = window - period + 1
    at, places = np.arange(max(0, len(words.row) - size + 1)), _places(words)
    inside = words.row[at] == words.row[at + size - 1] if len(at) else np.empty(0, bool)
    covered = np.isin(places[at] % period, difference_cover(period))
    at = at[inside & covered & (words.counts()[words.row[at]] >= window)]
    return words.window_hashes(at, size), ids[words.first + words.row[at]], places[at].astype(np.int32)


def _anchor_batches(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[repeats.Entries]:
    def each() -> Iterator[repeats.Entries]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for words in slices(batch["text"]):
                yield _anchors(ids, words, window, period)

    return repeats.gathered(each())


def shared_anchors(docs: DataFrame, bits: int, parts: int, window: int = WINDOW, period: int = PERIOD) -> DataFrame:
    """Owners and places of the anchors that more than one document holds, by part of the owner."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _anchor_batches(batches, window, period):
            yield repeats.sent_batch(entries, bits)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for entries in _anchor_batches(batches, window, period):
            yield repeats.found_batch(*repeats.known(entries, repeats.shared), parts)

    sent = docs.select("doc_id", "text").mapInArrow(send, repeats.NARROW)
    settled = docs.select("doc_id", "text").mapInArrow(settle, repeats.FOUND)
    return repeats.meet(sent, repeats.shared, parts, bits).union(settled)


class _Marks:
    """Sorted (id, place) pairs to look words up in."""

    def __init__(self, table: pa.Table):
        owners, places = repeats.flat(table, "owners"), repeats.flat(table, "places")
        order = np.lexsort((places, owners))
        self.owners, self.places = owners[order], places[order]

    def on(self, ids: np.ndarray, words: Words) -> np.ndarray:
        """Which words of a slice are marked."""
        marked = np.zeros(len(words.row), bool)
        bounds = words.bounds()
        own = ids[words.first : words.first + words.n]
        first, last = np.searchsorted(self.owners, own, "left"), np.searchsorted(self.owners, own, "right")
        for r in np.flatnonzero(last > first):
            places = bounds[r] + self.places[first[r] : last[r]]
            marked[places[places < bounds[r + 1]]] = True
        return marked


def _spread(marked: np.ndarray, row: np.ndarray, back: int, on: int) -> np.ndarray:
    """Words from ``back`` before to ``on`` after a marked word of the same row."""
    out = marked.copy()
    n = len(marked)
    for k in range(1, min(back, n - 1) + 1):
        out[: n - k] |= marked[k:] & (row[: n - k] == row[k:])
    for k in range(1, min(on, n - 1) + 1):
        out[k:] |= marked[: n - k] & (row[k:] == row[: n - k])
    return out


def _kept(words: Words, removed: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The number of words removed from each row of a slice, and those kept, joined by one space."""
    data, bounds = words.data.tobytes(), words.bounds()
    for r in range(words.n):
        found = data[words.offsets[r] : words.offsets[r + 1]].split()
        gone = removed[bounds[r] : bounds[r + 1]]
        if gone.any():
            found = compress(found, ~gone)
        yield int(gone.sum()), b" ".join(found)


def _filled(schema: pa.Schema, **columns: pa.Array) -> pa.Table:
    """A table of the schema; columns that are not given are null."""
    n = len(next(iter(columns.values())))
    return pa.Table.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
    )


def _results(schema: pa.Schema, table: pa.Table, cut: list[Words], removed: list[np.ndarray], carry: bool) -> pa.Table:
    """RESULT for a table of documents, and with ``carry`` their text and further columns."""
    counts, gone, digests, texts = [], [], [], []
    before = table["text"].to_pylist() if carry else []
    for words, mask in zip(cut, removed, strict=True):
        counts += words.counts().tolist()
        for n, kept in _kept(words, mask):
            if carry:
                texts.append(kept.decode() if n else before[len(gone)])
            gone.append(n)
            digests.append(hashlib.sha256(kept).hexdigest())
    columns = {
        "doc_id": table["doc_id"].combine_chunks(),
        "n_words": pa.array(counts, pa.int64()),
        "n_removed": pa.array(gone, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()),
    }
    if carry:
        columns |= {"text": pa.array(texts, pa.string()), "row": table["row"].combine_chunks()}
    return _filled(schema, **columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs.

    ``carry`` adds ``text``, the text that is left (unchanged where nothing went), and ``row``, a struct of the
    other columns.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    result = RESULT
    if carry:
        rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
        plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", rest)
        result = f"{RESULT}, text string, row {plain.schema['row'].dataType.simpleString()}"
    size = plain.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = len(difference_cover(period)) / period
    parts = repeats.prime_from(-(-size // PART_BYTES) + 1)
    bits = repeats.bits_for(size / WORD_BYTES)
    named = plain.where("doc_id is not null")
    anchors = shared_anchors(named, repeats.bits_for(share * size / WORD_BYTES), parts, window, period)
    final = _arrow(result)
    everywhere = plain.agg(F.count("doc_id")).first()[0]

    def around(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Hash the windows around shared anchors, and settle what one group of texts can."""
        out = [_SENT.empty_table()]
        if len(texts) and len(found):
            marks, ids = _Marks(found), texts["doc_id"].combine_chunks().to_numpy()
            entries, names = [], []
            for words in slices(texts["text"]):
                at = np.flatnonzero(_spread(marks.on(ids, words), words.row, period - 1, 0))
                at = at[at + window <= words.bounds()[words.row[at] + 1]]
                owners, places = ids[words.first + words.row[at]], _places(words)[at].astype(np.int32)
                entries.append((words.window_hashes(at, window, 1), owners, places))
                names.append(words.window_hashes(at, window, 2))
            sent = repeats.concatenated(entries)
            known = repeats.found_batch(*repeats.known(sent, repeats.later), parts)
            batches = repeats.sent_batch(sent, bits, np.concatenate(names)), repeats.settled_batch(known, bits, pa.int64())
            out += [pa.Table.from_batches([b]).cast(_SENT) for b in batches]
        return pa.concat_tables(out)

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        """Drop the words of the windows that a smaller id has too."""
        if not len(texts):
            return final.empty_table()
        marks, ids, cut = _Marks(found), texts["doc_id"].combine_chunks().to_numpy(), list(slices(texts["text"]))
        removed = [_spread(marks.on(ids, words), words.row, 0, window - 1) for words in cut]
        return _results(final, texts, cut, removed, carry)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = repeats.Bitmap(*outside.value)
        for batch in batches:
            ids = batch["doc_id"]
            named_too = pc.and_(ids.is_valid(), pa.array(others.has(pc.fill_null(ids, 0).to_numpy())))
            table = pa.Table.from_batches([batch.filter(pc.invert(named_too))])
            cut = list(slices(table["text"]))
            yield from _results(final, table, cut, [np.zeros(len(w.row), bool) for w in cut], carry).to_batches()

    marks = repeats.bitmap_bits(everywhere)
    anchors = written(spark, anchors, "anchors")
    holders = repeats.among(named.select("doc_id", "text"), repeats.bitmap_of(repeats.owners_of(anchors), marks))
    holders = repeats.by_part(holders, "doc_id", parts).groupBy("_part")
    sent = holders.cogroup(anchors.groupBy("part")).applyInArrow(around, repeats.ENTRIES)
    later = written(spark, repeats.meet(sent, repeats.later, parts, bits), "later")
    held = repeats.bitmap_of(repeats.owners_of(later), marks)
    changed = repeats.by_part(repeats.among(named, held), "doc_id", parts).groupBy("_part")
    changed = changed.cogroup(later.groupBy("part")).applyInArrow(finish, result)
    outside = spark.sparkContext.broadcast((held.bits, held.data.tobytes()))
    return changed.union(plain.mapInArrow(whole, result))


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))
