"""Chat formatting with built-in functions only.

A finite-state machine over roles judges the order of turns, and a declarative template turns each
conversation into text segments with a loss flag each. Control marks hold angle brackets, which the
template escapes out of roles and texts, so that formatted text can be read back without loss.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """What marks a turn, how marks inside texts are escaped, what the model learns, and which orders are valid."""

    turn_open: tuple[str, str] = ("<turn ", ">\n")
    turn_close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: applied in this order, undone in the opposite one; the backslash comes first
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
    start: str = "start"
    final: tuple[str, ...] = ("user", "assistant", "tool")
    #: (state, role) to the next state; anything else is invalid
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
            ("assistant", "user"): "user", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant",
        }
    )

    def escape(self, text: Column) -> Column:
        for raw, safe in self.escapes:
            text = F.replace(text, F.lit(raw), F.lit(safe))
        return text

    def unescape(self, text: Column) -> Column:
        for raw, safe in reversed(self.escapes):
            text = F.replace(text, F.lit(safe), F.lit(raw))
        return text


def valid_order(turns: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Runs the machine over an array of turns; true if no move is missing and the last state is final."""
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    end = F.aggregate(turns, F.lit(template.start), lambda state, t: F.coalesce(F.element_at(moves, F.concat(state, F.lit("\n"), t["role"])), F.lit("invalid")))
    return end.isin(*template.final)


def format_chats(conversations: DataFrame, template: ChatTemplate = ChatTemplate(), keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text")) -> DataFrame:
    """One row per conversation: conv_id, valid, segments (array of text and loss), formatted.

    A conversation becomes one text, so its turns meet in one row; their number is what a single text
    holds. Turns are ordered by turn, then role and text, nulls first; repeated rows stay. A null role
    or text is empty. A row without a conv_id is a conversation of its own, with a null conv_id: nothing says which
    rows would belong together, and all of them in one row would have no bound. No input gives no row.
    """
    conv, turn, role, text = (F.col(k) for k in keys)
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    one = F.struct(turn.alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    rows = conversations.select(conv.alias("conv_id"), one.alias("one"))
    # A conversation's number keeps its rows together; without one, a row's own number keeps it apart.
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    out = rows.withColumn("lone", lone).groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    seg = lambda body, loss: F.struct(body.alias("text"), loss.alias("loss"))
    head, tail = template.turn_open
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                seg(F.concat(F.lit(head), template.escape(t["role"]), F.lit(tail)), F.lit(False)),
                seg(template.escape(t["text"]), t["role"].isin(*template.loss_roles)),
                seg(F.lit(template.turn_close), F.lit(False)),
            ),
        )
    )
    out = out.select("conv_id", valid_order(F.col("turns"), template).alias("valid"), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join("segments.text", ""))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns (array of role and text) that a formatted text holds."""
    head, tail = template.turn_open
    pattern = F.lit(f"{head}([^<>]*){tail}([^<>]*){template.turn_close}")
    parts = F.arrays_zip(F.regexp_extract_all(formatted, pattern, 1).alias("role"), F.regexp_extract_all(formatted, pattern, 2).alias("text"))
    return F.transform(parts, lambda p: F.struct(template.unescape(p["role"]).alias("role"), template.unescape(p["text"]).alias("text")))


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
