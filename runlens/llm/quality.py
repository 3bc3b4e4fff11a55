"""Quality rules as a short-circuit cascade.

Every rule is timed and counted on a sample; rules then run in the order of rejections per second, each only on the
documents that no earlier rule rejected. A document is kept when no rule rejects it, so the order, which timing
decides, changes the cost and never the verdict.

The base figures of every document are counted first, whole texts at a time: they are results, and documents that
fail on them do not enter the cascade.

Defined cases: null and empty texts have no words and fail the base rules; rows that repeat each get their row;
null ids are carried as they are. Extra columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import SPACES, Words, byte_table, slices

#: The order of the rules is estimated on about so many documents.
SAMPLE_ROWS = 2_000
LEAST_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_PERCENT = 20

_SYMBOL = byte_table(b"#*$%&|<>")
_CONTINUES = byte_table(bytes(range(0x80, 0xC0)))
_LOWER = byte_table(bytes(range(97, 123)))
_UPPER = byte_table(bytes(range(65, 91)))
_CALL = byte_table(b"!")
_SPACE = byte_table(SPACES)

FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = "doc_id bigint, " + ", ".join(f"{f} bigint" for f in FIGURES) + ", base_failed boolean, kept boolean"


def _before(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags)])


def per_row(words: Words, flags: np.ndarray) -> np.ndarray:
    """How many bytes of each row have the flag."""
    sums = _before(flags)
    return sums[words.offsets[1:]] - sums[words.offsets[:-1]]


def per_word(words: Words, flags: np.ndarray) -> np.ndarray:
    sums = _before(flags)
    return sums[words.ends] - sums[words.starts]


def _sum_words(words: Words, values: np.ndarray) -> np.ndarray:
    sums, bounds = _before(values), words.bounds()
    return sums[bounds[1:]] - sums[bounds[:-1]]


def lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word in each row, and those of them that equal an earlier one."""
    data, some, repeated = words.data.tobytes(), np.zeros(words.n, np.int64), np.zeros(words.n, np.int64)
    for r in range(words.n):
        found = [x for x in data[words.offsets[r] : words.offsets[r + 1]].split(b"\n") if x and not x.isspace()]
        some[r], repeated[r] = len(found), len(found) - len(set(found))
    return some, repeated


def repeat_words(words: Words, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Words of each row in windows that occur in the row more than once."""
    at, hashes = words.windows(size)
    order = np.lexsort((hashes, words.row[at]))
    row, value = words.row[at][order], hashes[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(words.row), bool)
    for k in range(size):
        covered[at[order[twice]] + k] = True
    return _sum_words(words, covered)


def only(words: Words, rows: np.ndarray) -> Words:
    """The chosen rows of a slice as a slice of their own."""
    length = np.diff(words.offsets)
    bytes_kept, words_kept = np.repeat(rows, length), rows[words.row]
    gone = _before(~bytes_kept)
    number = np.cumsum(rows) - 1
    offsets = np.concatenate([[0], np.cumsum(length[rows])])
    starts, ends = words.starts[words_kept], words.ends[words_kept]
    return Words(
        words.first, int(rows.sum()), words.data[bytes_kept], offsets, starts - gone[starts], ends - gone[starts],
        number[words.row[words_kept]], words.hashes[words_kept],
    )


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Words], np.ndarray]


def _symbols(words: Words) -> np.ndarray:
    return 10 * per_row(words, _SYMBOL[words.data]) > words.counts()


def _calls(words: Words) -> np.ndarray:
    return 10 * per_row(words, _CALL[words.data]) > 3 * words.counts()


def _shouting(words: Words) -> np.ndarray:
    loud = (per_word(words, _UPPER[words.data]) >= 2) & (per_word(words, _LOWER[words.data]) == 0)
    return 10 * _sum_words(words, loud) > 3 * words.counts()


def _stuttering(words: Words) -> np.ndarray:
    same = np.zeros(len(words.row), bool)
    same[1:] = (words.row[1:] == words.row[:-1]) & (words.hashes[1:] == words.hashes[:-1])
    return 10 * _sum_words(words, same) > 3 * words.counts()


def _word_length(words: Words) -> np.ndarray:
    chars = _sum_words(words, per_word(words, ~_CONTINUES[words.data]))
    return (chars < 2 * words.counts()) | (chars > 12 * words.counts())


def _lines(words: Words) -> np.ndarray:
    some, repeated = lines(words)
    return (some > 4) & (10 * repeated > 4 * some)


RULES = (
    Rule("symbols", _symbols),
    Rule("calls", _calls),
    Rule("shouting", _shouting),
    Rule("stuttering", _stuttering),
    Rule("word_length", _word_length),
    Rule("lines", _lines),
)


def figures(words: Words) -> dict[str, np.ndarray]:
    """The base figures of each row."""
    return {
        "n_words": words.counts(),
        "word_chars": _sum_words(words, per_word(words, ~_CONTINUES[words.data])),
        "n_symbols": per_row(words, _SYMBOL[words.data]),
        "n_dup_lines": lines(words)[1],
        "n_repeat_words": repeat_words(words),
    }


def _base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < LEAST_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS, seed: int = 1) -> list[Rule]:
    """The rules by rejections per second on a sample of texts, the best first."""
    n = docs.count()
    sample = docs.select("text").sample(min(1.0, rows / max(n, 1)), seed)

    def time_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch["text"]):
                words = only(words, words.counts() >= LEAST_WORDS)
                cost, rejected = [], []
                for rule in rules:
                    began = time.perf_counter()
                    rejected.append(int(rule.rejects(words).sum()))
                    cost.append(time.perf_counter() - began)
                columns = [pa.array(range(len(rules)), pa.int32()), pa.array(cost), pa.array(rejected, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["rule", "cost", "rejected"])

    timed = sample.mapInArrow(time_rules, "rule int, cost double, rejected bigint").groupBy("rule")
    timed = {r["rule"]: r for r in timed.agg(F.sum("cost").alias("cost"), F.sum("rejected").alias("rejected")).collect()}
    if not timed:
        return list(rules)
    best = sorted(timed, key=lambda k: (-timed[k]["rejected"] / max(timed[k]["cost"], 1e-9), timed[k]["cost"]))
    return [rules[k] for k in best]


def verdict(words: Words, rules: Sequence[Rule], alive: np.ndarray) -> np.ndarray:
    """Which of the rows that are alive no rule rejects."""
    kept = alive.copy()
    left = only(words, kept) if not kept.all() else words
    for rule in rules:
        if not left.n:
            break
        rejected = rule.rejects(left)
        if rejected.any():
            kept[np.flatnonzero(kept)[rejected]] = False
            left = only(left, ~rejected)
    return kept


def assess(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The base figures and the verdict of every row of (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = order_rules(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in slices(batch["text"]):
                found = figures(words)
                failed = _base_failed(found)
                columns = [
                    batch["doc_id"].slice(words.first, words.n),
                    *[pa.array(found[f].astype(np.int64)) for f in FIGURES],
                    pa.array(failed),
                    pa.array(verdict(words, ordered, ~failed)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *FIGURES, "base_failed", "kept"])

    return docs.mapInArrow(run, RESULT)
