"""Chat formatting from a declarative template.

A finite-state machine over roles judges the order of turns; every conversation is written
as segments with a loss flag each. Characters that begin or end a control string are
followed by a backslash inside roles and texts, and so is the backslash itself, so no
control string can appear there and the output can be read back exactly.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template: control strings, roles under loss, and the machine's transitions and accepting states.
TEMPLATE: dict[str, Any] = {
    "begin": "<s>",
    "open": "[",
    "named": "] ",
    "close": " </s>",
    "loss_roles": ["assistant"],
    "start": "start",
    "transitions": {
        "start": {"system": "system", "user": "user"},
        "system": {"user": "user"},
        "user": {"assistant": "assistant"},
        "assistant": {"user": "user"},
    },
    "accepting": ["assistant"],
}
#: Characters escaped in roles and texts; "<" and "[" begin control strings and "]" ends a role.
ESCAPED = r"([\[\]<\\])"
REJECT = "reject"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED + r"\\", "$1")


def final_state(roles: Column, template: dict[str, Any] = TEMPLATE) -> Column:
    """The state that the machine ends in after a list of roles; a missing transition rejects for good."""
    moves = [F.lit(x) for state, to in template["transitions"].items() for role, then in to.items() for x in (f"{state}>{role}", then)]
    table = F.create_map(*moves)
    step = lambda state, role: F.coalesce(F.try_element_at(table, F.concat(state, F.lit(">"), role)), F.lit(REJECT))
    return F.aggregate(roles, F.lit(template["start"]), step)


def format_conversations(turns: DataFrame, template: dict[str, Any] = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments of (text, loss), n_turns, valid.

    Turns are ordered by turn, then role and text where turns repeat; a repeated row is a
    turn of its own. Null roles and texts are empty, null turns come first, null conv_ids
    make one conversation. Conversations that the machine rejects are formatted as well, with
    valid false. Other columns are not read; an empty table gives no conversation. A
    conversation must fit a row, as its formatted text does.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(t: Column) -> Column:
        opening = F.concat(F.lit(template["open"]), escape(t["role"]), F.lit(template["named"]))
        body = segment(escape(t["text"]), t["role"].isin(template["loss_roles"]))
        return F.array(segment(opening, F.lit(False)), body, segment(F.lit(template["close"]), F.lit(False)))

    begin = F.array(segment(F.lit(template["begin"]), F.lit(False)))
    cut = whole.select("conv_id", "turns", F.concat(begin, F.flatten(F.transform("turns", segments))).alias("segments"))
    return cut.select(
        "conv_id",
        F.array_join(F.col("segments")["text"], "").alias("formatted"),
        "segments",
        F.size("turns").cast("long").alias("n_turns"),
        final_state(F.col("turns")["role"], template).isin(template["accepting"]).alias("valid"),
    )


def read_turns(formatted: Column, template: dict[str, Any] = TEMPLATE) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    body = F.substring(formatted, len(template["begin"]) + 1, 1 << 30)
    parts = F.split(body, "\\Q" + template["close"] + "\\E", -1)
    written = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(part: Column) -> Column:
        at = F.locate(template["named"], part)
        role = F.substr(part, F.lit(len(template["open"]) + 1), at - (len(template["open"]) + 1))
        return F.struct(unescape(role).alias("role"), unescape(F.substr(part, at + len(template["named"]))).alias("text"))

    return F.transform(written, turn)


def read_loss(segments: Column) -> Column:
    """All text under loss, unescaped, in order and with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digests(turns: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation, as counts and SHA-256 digests."""
    done = format_conversations(turns).select("*", read_turns(F.col("formatted")).alias("back"), read_loss(F.col("segments")).alias("loss"))
    lines = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
