"""Spelling variants of words, by a trie over letter counts.

1. Words are counted once over all documents.
2. A word becomes the vector of how often it has each group of letters. One inserted, deleted or replaced code point
   adds at most one to one count (surplus) and takes at most one from another (deficit). Words are arranged in a trie by
   successive counts; a depth-first walk over pairs of nodes spends a budget of one surplus and one deficit, and the
   words of the leaves it reaches are compared letter by letter.
3. The first ``ROUTE`` counts deal the trie to tasks. A word visits the parts that its budget reaches and that come
   after its own, so every pair meets once. Parts of many words are split into blocks; a block sends one row per word:
   how many near words, and the best.
4. The near word of largest count is a word's form if it is at least twice as frequent. Counts double along a chain of
   forms, so pointer jumping reaches every root in a few rounds.

Defined cases: null and empty texts have no words; a null id counts as an empty one; rows that repeat an id are documents of
their own; words of any length take part. No rows give no rows. Extra columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.blocks import in_blocks
from runlens.llm.components import written

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point where this number divides its hash.
ONE_IN = 97
#: A form is so many times as frequent as the word.
FORM_TIMES = 2
#: Letters whose counts are taken together, the telling ones first; all others are the last group.
GROUPS = ("e", "t", "a", "i", "n", "s", "o", "r", "l", "h", "d", "c", "u", "mw", "gp", "fy", "bv")
ROUTE = 4
BLOCK_WORDS = 65_536
#: A task sends its counts when so many words have come together.
_MOST_WORDS = 200_000

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_GROUP = np.full(129, len(GROUPS), np.int64)
for _k, _group in enumerate(GROUPS):
    _GROUP[[ord(letter) for letter in _group]] = _k
#: Work on arrays of about so many elements.
_PAIRS_AT_ONCE, _LETTERS_AT_ONCE = 1 << 15, 1 << 20


def lost_letter(prefix: int, run: str) -> str:
    """The run, or the run less one code point, as the hash of the id (``prefix``) and the run decides."""
    h = crc32(run.encode(), prefix)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of (doc_id, text) that come ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                prefix = crc32(f"{'' if doc.as_py() is None else doc.as_py()}:".encode())
                for run, n in Counter(_RUN.findall((text.as_py() or "").translate(_UPPER))).items():
                    word = lost_letter(prefix, run)
                    if len(word) >= LEAST_LENGTH:
                        seen[word] += n
                if len(seen) > _MOST_WORDS:
                    yield sent()
        yield sent()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


@cache
def parts_of(own: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The first counts of a word, and those after them that its budget reaches: one more, one less, or one of each."""
    out = []
    for up in range(-1, ROUTE):
        for down in range(-1, ROUTE):
            there = list(own)
            if up >= 0:
                there[up] += 1
            if down >= 0:
                there[down] -= 1
            if min(there) >= 0 and tuple(there) >= own and (up != down or up < 0):
                out.append(tuple(there))
    return out


class Words:
    """Words as one run of code points."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.length) - self.length
        all_words = np.arange(len(words))
        self.heads, self.tails = {}, {}
        for k in (2, 3):
            place = np.arange(k)
            self.heads[k] = self._packed(self._letters(all_words, np.broadcast_to(place, (len(words), k))))
            self.tails[k] = self._packed(self._letters(all_words, self.length[:, None] - 1 - place))

    @staticmethod
    def _packed(letters: np.ndarray) -> np.ndarray:
        out = np.zeros(len(letters), np.int64)
        for column in letters.T:
            out = (out << 21) | column
        return out

    def may_be_near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of words begin or end alike, as one edit leaves one half of words of five letters or more."""
        shorter = np.minimum(self.length[a], self.length[b])
        two, three = ((self.heads[k][a] == self.heads[k][b]) | (self.tails[k][a] == self.tails[k][b]) for k in (2, 3))
        return (shorter < 5) | np.where(shorter < 6, two, three)

    def counts(self) -> np.ndarray:
        """How often each word has each group of letters."""
        n, groups = len(self.length), len(GROUPS) + 1
        row = np.repeat(np.arange(n), self.length)
        return np.bincount(row * groups + _GROUP[np.minimum(self.codes, len(_GROUP) - 1)], minlength=n * groups).reshape(n, groups)

    def _letters(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The code points at these places; 0 outside a word."""
        inside = (at >= 0) & (at < self.length[words][:, None])
        return np.where(inside, self.codes[np.minimum(np.maximum(self.start[words][:, None] + at, 0), len(self.codes) - 1)], 0)

    def one_edit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether one inserted, deleted or replaced code point makes word ``b`` of word ``a``, for arrays of words."""
        out = np.zeros(len(a), bool)
        apart = np.abs(self.length[a] - self.length[b])
        longest = np.maximum(self.length[a], self.length[b])
        left = np.flatnonzero(apart <= 1)
        left = left[np.argsort(longest[left], kind="stable")]
        while len(left):
            some = left[: max(1, int(np.searchsorted(longest[left] * np.arange(1, len(left) + 1), _LETTERS_AT_ONCE, "right")))]
            left = left[len(some) :]
            x, y, width = a[some], b[some], int(longest[some[-1]])
            place = np.arange(width)
            same = self._letters(x, place[None, :]) == self._letters(y, place[None, :])
            ends = self._letters(x, self.length[x][:, None] - 1 - place) == self._letters(y, self.length[y][:, None] - 1 - place)
            begins = np.where(same.all(axis=1), width, same.argmin(axis=1))
            ends = np.where(ends.all(axis=1), width, ends.argmin(axis=1))
            replaced = (~same).sum(axis=1) == 1
            out[some] = np.where(apart[some] == 0, replaced, begins + ends >= longest[some] - 1)
        return out


def one_edit(a: str, b: str) -> bool:
    return bool(Words([a, b]).one_edit(np.array([0]), np.array([1]))[0])


class Trie:
    """Words by successive letter counts, as arrays: the nodes of a level are the distinct prefixes, in order."""

    def __init__(self, counts: np.ndarray, words: np.ndarray):
        order = np.lexsort(counts[words].T[::-1])
        self.words, counts = words[order], counts[words[order]]
        n, depth = counts.shape
        new = np.zeros(n, bool)
        new[:1] = True
        first = np.zeros(min(n, 1), np.int64)
        self.value, self.parent, self.children = [], [], []
        for level in range(depth):
            new[1:] |= counts[1:, level] != counts[:-1, level]
            above, first = first, np.flatnonzero(new)
            self.value.append(counts[first, level])
            self.parent.append(np.searchsorted(above, first, "right") - 1)
            self.children.append(np.append(np.searchsorted(first, above), len(first)))
        self.leaves = np.append(first, n)


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span its own number and all numbers in it."""
    n = last - first
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]


#: Counts of the other word less counts of the one: none, a surplus, a deficit.
_STEPS = ((0, False, False), (1, True, False), (-1, False, True))


def reached(one: Trie, other: Trie) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of two tries whose counts differ by at most one surplus and one deficit.

    A depth-first walk over pairs of nodes, some thousand pairs at a time. A trie is compared with itself once.
    """
    if not len(one.words) or not len(other.words):
        return
    depth, itself = len(one.value), one is other
    base = 3 + max(int(v.max()) for t in (one, other) for v in t.value)
    keys = [p * base + v for p, v in zip(other.parent, other.value, strict=True)]
    stack = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, bool))]
    while stack:
        level, a, b, surplus, deficit = stack.pop()
        if level == depth:
            at, x = _spans(one.leaves[a], one.leaves[a + 1])
            b = b[at]
            cuts = np.unique(np.searchsorted(np.cumsum(other.leaves[b + 1] - other.leaves[b]), np.arange(0, len(b) * 64 + 1, _PAIRS_AT_ONCE)))
            for i, j in zip(cuts, [*cuts[1:], len(b)], strict=True):
                at, y = _spans(other.leaves[b[i:j]], other.leaves[b[i:j] + 1])
                yield one.words[x[i:j][at]], other.words[y]
            continue
        at, child = _spans(one.children[level][a], one.children[level][a + 1])
        b, surplus, deficit = b[at], surplus[at], deficit[at]
        key, found = b * base + one.value[level][child], []
        for step, more, less in _STEPS:
            place = np.minimum(np.searchsorted(keys[level], key + step), len(keys[level]) - 1)
            met = keys[level][place] == key + step
            if more:
                met &= ~surplus
            if less:
                met &= ~deficit
            if itself:
                met &= child <= place
            found.append((child[met], place[met], surplus[met] | more, deficit[met] | less))
        merged = [np.concatenate(x) for x in zip(*found, strict=True)]
        for start in range(0, len(merged[0]), _PAIRS_AT_ONCE):
            stack.append((level + 1, *(x[start : start + _PAIRS_AT_ONCE] for x in merged)))


def near_words(counted: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n) of every row of (word, n): the near word of largest count, whatever it is."""
    spark = counted.sparkSession

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts, guests = [], [], []
            for i, own in enumerate(map(tuple, Words(batch["word"].to_pylist()).counts()[:, :ROUTE].tolist())):
                for part in parts_of(own):
                    at.append(i)
                    parts.append("-".join(map(str, part)))
                    guests.append(part != own)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(parts, pa.string()), pa.array(guests, pa.bool_())], ["word", "n", "part", "guest"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        words, n, chunk, guest = group["word"].to_pylist(), group["n"].to_numpy(), group["chunk"].to_numpy(), group["guest"].to_numpy(zero_copy_only=False)
        across = key[1].as_py() != key[2].as_py()
        letters = Words(words)
        counts = letters.counts()
        homes, guests = (Trie(counts, np.flatnonzero(guest == g)) for g in (False, True))
        # By (count, word), the best first.
        ranked = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)
        rank = np.empty(len(words), np.int64)
        rank[ranked] = np.arange(len(words))
        many, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
        for trie in (homes, guests):
            for x, y in reached(trie, homes):
                meet = x != y
                if across:
                    meet &= chunk[x] != chunk[y]
                x, y = x[meet], y[meet]
                if trie is homes:
                    # Words of one leaf meet both ways.
                    one_way = (counts[x] != counts[y]).any(axis=1) | (x < y)
                    x, y = x[one_way], y[one_way]
                likely = letters.may_be_near(x, y)
                x, y = x[likely], y[likely]
                near = letters.one_edit(x, y)
                for i, j in ((x[near], y[near]), (y[near], x[near])):
                    many += np.bincount(i, minlength=len(words))
                    np.minimum.at(best, i, rank[j])
        some = np.flatnonzero(many)
        return pa.table(
            {
                "word": pa.array([words[i] for i in some], pa.string()),
                "n_near": pa.array(many[some]),
                "form": pa.array([words[ranked[best[i]]] for i in some], pa.string()),
                "form_n": pa.array([int(n[ranked[best[i]]]) for i in some], pa.int64()),
            }
        )

    counted = written(spark, counted.select("word", F.col("n").cast("bigint").alias("n")), "words")
    routed = written(spark, counted.mapInArrow(route, "word string, n bigint, part string, guest boolean"), "routed")
    blocks = in_blocks(routed, ["part"], "word", BLOCK_WORDS).groupBy("part", "first", "second")
    found = blocks.applyInArrow(compare, "word string, n_near bigint, form string, form_n bigint")
    order = F.struct((-F.col("form_n")).alias("less"), "form")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("best"))
    met = counted.join(found, "word", "left")
    return met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "best.form", (-F.col("best.less")).alias("form_n"))


def variants(counted: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every row of (word, n)."""
    spark = counted.sparkSession
    near = near_words(counted)
    enough = F.col("form_n") >= FORM_TIMES * F.col("n")
    near = near.withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n")))
    near = written(spark, near, "near")
    # A word without a form is its own root, so only words with one need to jump.
    jumps = written(spark, near.where("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(spark, jumps.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "jumps")
        jumps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return near.join(jumps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
