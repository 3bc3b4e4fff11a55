"""Chat formatting in budgeted windows, with DataFrame operations only.

A conversation becomes one or more windows of turns. Prefix sums of the turns' tokens cut it into stretches of
``STRETCH`` windows' room; within a stretch each window takes turns as its targets until the next one would not fit.
A window holds the system turn, then the turns at the end of the window before that begin within ``history`` tokens of
its first target, then its targets. The loss mask covers the texts of target turns of the learned role, so every such
text is under the mask once however often it is repeated as history.

The room of a window is what the budget leaves beside the system turn and the history, but never less than the history;
the first window, which has no history, has the room for it too. A turn is repeated once at most. A window exceeds the budget only
where a single turn is longer than its room, or the system turn leaves less room than the history. Two windows that follow one
another in a stretch hold more than one room, so a long turn costs its neighbours nothing elsewhere; a stretch loses
part of one window at its end.

Control strings in texts and roles are escaped: ``&`` as ``&amp;``, ``<|`` as ``&lt;|`` and, in roles, a new line as ``&#10;``.

Defined cases: null roles and texts are empty; null turns come first; rows that repeat a turn are turns of their own, in
the order of role and text; a null conversation id is one conversation; a conversation of a system turn alone is one
window without targets. Extra columns play no part. No group larger than a window is collected to format; a
conversation of millions of turns is cut on its order for the prefix sums. Digests of a whole conversation need
its text in one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.plans.ordered import join_unique, row_number, running_sum, with_ordered

BUDGET = 2048
HISTORY = 256
#: A stretch, whose turns one task walks in order, begins so many turns' tokens as fill the room of STRETCH windows.
STRETCH = 16
#: Numbers of windows reserved for a stretch; two of its windows hold more than one room, so it has 2 * STRETCH + 2 at most.
NUMBERS = 64
SYSTEM = "system"
LEARNED = "assistant"
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def n_tokens(text: Column) -> Column:
    """Tokens of a turn, about: runs of ASCII letters and digits, other characters but spaces, and 4 for the marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]")) + 4


def _segments(turns: Column) -> Column:
    """The text of an array of turns, and where the learned ones stand in it."""

    def add(made: Column, turn: Column) -> Column:
        head = F.concat(F.lit(START), turn["role"], F.lit("\n"))
        text = F.concat(made["text"], head, turn["text"], F.lit(END))
        span = F.struct((F.length(made["text"]) + F.length(head)).alias("start"), F.length(turn["text"]).alias("length"))
        spans = F.when(turn["learn"], F.concat(made["spans"], F.array(span))).otherwise(made["spans"])
        return F.struct(text.alias("text"), spans.alias("spans"))

    empty = F.struct(F.lit("").alias("text"), F.expr("array()").cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, empty, add)


def _starts(turns: DataFrame, history: int) -> DataFrame:
    """(_conv, _stretch, _starts, _stop): where the windows of each stretch begin, and where its last turn ends.

    Only places and tokens are gathered, of the turns that begin in one stretch: a turn has 4 tokens at least.
    """

    def walk(made: Column, turn: Column) -> Column:
        filled = made["filled"] + turn["tokens"]
        none, full = F.size(made["starts"]) == 0, filled > made["room"]
        return F.struct(
            F.when(full & ~none, turn["tokens"]).otherwise(filled).alias("filled"),
            F.when(full | none, F.concat(made["starts"], F.array(turn["begin"]))).otherwise(made["starts"]).alias("starts"),
            made["room"].alias("room"),
        )

    one = F.struct(F.col("_begin").alias("begin"), F.col("_tokens").alias("tokens"))
    stretches = turns.groupBy("_conv", "_stretch").agg(
        F.array_sort(F.collect_list(one)).alias("_turns"), F.first("_room").alias("_room"), F.max(F.col("_begin") + F.col("_tokens")).alias("_stop")
    )
    empty = F.struct(
        F.when(F.col("_stretch") == 0, -history).otherwise(0).cast("bigint").alias("filled"),
        F.expr("array()").cast("array<bigint>").alias("starts"),
        F.col("_room").alias("room"),
    )
    starts = F.aggregate("_turns", empty, walk)["starts"]
    return stretches.select("_conv", "_stretch", starts.alias("_starts"), "_stop")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, learned: str = LEARNED) -> DataFrame:
    """(conv_id, window, formatted, spans, n_repeated, n_tokens): ``spans`` are the starts and lengths under the loss mask,
    in code points; ``n_repeated`` turns at the head of the window have been targets of an earlier one."""
    blank = F.lit("")
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    ).withColumn("_tokens", n_tokens(F.col("text")).cast("bigint"))
    order = ["turn", "role", "text"]
    turns = with_ordered(turns, ["conv_id"], order, {"_place": row_number(), "_end": running_sum("_tokens")})
    turns = turns.withColumn("_system", (F.col("_place") == 1) & (F.col("role") == SYSTEM))
    # Null ids match nothing in a join: the key is the id as a string, with a mark of its own for null.
    turns = turns.withColumn("_conv", F.coalesce(F.col("conv_id").cast("string"), blank))
    of_system = [F.max(F.when(F.col("_system"), F.col(c))) for c in ("role", "text", "_tokens")]
    stats = turns.groupBy("_conv").agg(
        of_system[0].alias("_system_role"),
        of_system[1].alias("_system_text"),
        F.coalesce(of_system[2], F.lit(0)).alias("_system_tokens"),
    )
    turns = join_unique(turns, stats, ["_conv"])
    room = F.greatest(F.lit(budget - history) - F.col("_system_tokens"), F.lit(history), F.lit(1)).cast("bigint")
    begin = F.col("_end") - F.col("_tokens") - F.col("_system_tokens")
    turns = turns.withColumn("_room", room).withColumn("_begin", F.when(F.col("_system"), F.lit(0)).otherwise(begin).cast("bigint"))
    stretch = F.expr(f"_begin div (_room * {STRETCH})")
    turns = turns.withColumn("_stretch", stretch)
    turns = turns.join(_starts(turns.where(~F.col("_system")), history), ["_conv", "_stretch"], "left")
    own = F.size(F.filter("_starts", lambda s: s <= F.col("_begin"))) - 1
    following = F.get("_starts", own + 1)
    beyond = F.expr(f"_stop div (_room * {STRETCH})")
    # The window after the last of a stretch is the first of the stretch in which the next turn begins, if there is one.
    after = F.when(following.isNotNull(), F.col("_first") + 1).when(beyond > F.col("_stretch"), beyond * NUMBERS)
    near = F.coalesce(following, F.col("_stop")) - F.col("_begin") <= history
    shown = turns.withColumn("_first", F.when(F.col("_system"), F.lit(0)).otherwise(F.col("_stretch") * NUMBERS + own).cast("bigint"))
    again = F.when(~F.col("_system") & near & after.isNotNull(), F.array("_first", after)).otherwise(F.array("_first"))
    shown = shown.withColumn("window", F.explode(again))
    target = F.col("window") == F.col("_first")
    one = F.struct(
        F.col("_place").alias("place"),
        _escape_role(F.col("role")).alias("role"),
        escape(F.col("text")).alias("text"),
        (target & (F.col("role") == learned)).alias("learn"),
        target.alias("target"),
        F.col("_tokens").alias("tokens"),
    )
    system = F.struct(
        F.lit(0).cast("bigint").alias("place"),
        _escape_role(F.col("_system_role")).alias("role"),
        escape(F.col("_system_text")).alias("text"),
        F.lit(False).alias("learn"),
        F.lit(False).alias("target"),
        F.col("_system_tokens").alias("tokens"),
    )
    grouped = shown.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(one)).alias("_turns"),
        F.first(F.when(F.col("_system_role").isNotNull(), system)).alias("_with"),
    )
    grouped = grouped.where(F.exists("_turns", lambda t: t["target"]))
    later = (F.col("window") > 0) & F.col("_with").isNotNull()
    grouped = grouped.withColumn("_turns", F.when(later, F.concat(F.array("_with"), "_turns")).otherwise(F.col("_turns")))
    made = grouped.withColumn("_made", _segments(F.col("_turns")))
    return made.select(
        "conv_id",
        "window",
        F.col("_made.text").alias("formatted"),
        F.col("_made.spans").alias("spans"),
        F.size(F.filter("_turns", lambda t: ~t["target"])).alias("n_repeated"),
        F.aggregate("_turns", F.lit(0).cast("bigint"), lambda n, t: n + t["tokens"]).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses, chars): the target turns as structs of role and text, and the texts under the mask."""
    pieces = F.split("formatted", r"<\|im_start\|>")
    fresh = F.slice(pieces, F.col("n_repeated") + 2, F.size(pieces))

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    losses = F.transform("spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"])))
    chars = F.length("formatted").cast("bigint").alias("chars")
    return formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), losses.alias("losses"), chars)


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of each conversation say when read back: counts and digests."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    window = F.struct(
        "window",
        F.size("turns").cast("bigint").alias("n"),
        F.array_join(said, "").alias("said"),
        F.array_join("losses", "").alias("loss"),
        "chars",
    )
    grouped = read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(window)).alias("w"))
    loss = F.array_join("w.loss", "")
    return grouped.select(
        "conv_id",
        F.aggregate("w.n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w.chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("formatted_chars"),
        F.size("w").alias("n_windows"),
    )
