"""Functions over log lines, ids and other text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens import constants as C


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _group(text: Column | str, pattern: str, index: int) -> Column:
    found = F.regexp_extract(_col(text), pattern, index)
    return F.when(found != "", found)


def format_duration(seconds: Column | str) -> Column:
    """F-03. ``2m 5.50s``, or ``5.50s`` below a minute."""
    s = _col(seconds)
    minutes, rest = F.floor(s / 60), s % 60
    # Rounded on the binary value, exact halves up. Where the product with 100 comes out at a half, it may have been
    # rounded itself: the three sums are exact and tell on which side of the half the value is.
    whole = F.floor(rest * 100)
    half = whole + F.lit(0.5)
    up = (rest * 100 > half) | ((rest * 100 == half) & ((rest * 64 - half) + rest * 32 + rest * 4 >= 0))
    rest = F.format_string("%.2fs", (whole + F.when(up, 1).otherwise(0)) / 100)
    text = F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), rest)).otherwise(rest)
    return F.when(s.isNotNull(), text)


def progress(line: Column | str) -> tuple[Column, Column]:
    """F-04. (epoch, total) of the first progress mark in the line, NULL when there is none.

    The line is searched once; the numbers are taken from the short match.
    """
    mark = F.regexp_extract(_col(line), C.PROGRESS_PATTERN, 1)
    return F.substring_index(mark, "/", 1).try_cast("bigint"), F.substring_index(mark, "/", -1).try_cast("bigint")


def has_progress(line: Column | str) -> Column:
    """The line has a progress mark. Filter on this before ``progress``: it is the cheaper test."""
    return _col(line).rlike(C.PROGRESS_PATTERN)


def epoch_line(line: Column | str) -> Column:
    """F-05. Struct (epoch, total, loss, accuracy, seconds) of an epoch summary line, NULL fields
    on other lines. The line is searched once and the match cut at its labels."""
    found = F.regexp_extract(_col(line), C.EPOCH_LINE_PATTERN, 1)

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(found, end, 1), start, -1)

    epochs = F.substring_index(found, " - ", 1)
    return F.struct(
        F.substring_index(epochs, "/", 1).try_cast("bigint").alias("epoch"),
        F.substring_index(epochs, "/", -1).try_cast("bigint").alias("total"),
        between("Loss: ", " - Acc: ").try_cast("double").alias("loss"),
        between("Acc: ", "%").try_cast("double").alias("accuracy"),
        F.substring_index(found, " - ", -1).try_cast("double").alias("seconds"),
    )


def is_epoch_line(line: Column | str) -> Column:
    """The line is an epoch summary. Filter on this before ``epoch_line``."""
    return _col(line).rlike(C.EPOCH_LINE_PATTERN)


def line_time(line: Column | str) -> Column:
    """F-05. The leading time of a log line (whole seconds)."""
    return F.to_timestamp(_group(line, C.LINE_TIME_PATTERN, 1), "yyyy-MM-dd HH:mm:ss")


def attempt_start(line: Column | str) -> tuple[Column, Column]:
    """First and last epoch announced when a run (re)starts, NULL on other lines."""
    return _group(line, C.ATTEMPT_PATTERN, 1).try_cast("bigint"), _group(line, C.ATTEMPT_PATTERN, 2).try_cast("bigint")


def short_id(value: Column | str) -> Column:
    """F-07."""
    return F.substring(value, 1, C.SHORT_ID_LENGTH)


def is_uuid(text: Column | str) -> Column:
    """F-10."""
    return _col(text).rlike(C.UUID_PATTERN)


def mask_credentials(url: Column | str) -> Column:
    """F-11. ``scheme://user:password@host`` becomes ``scheme://*****@host``."""
    return F.regexp_replace(_col(url), "://[^@]+@", "://*****@")
