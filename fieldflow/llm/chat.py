"""Chat formatting by a declarative template, in DataFrame functions alone.

A template names the text before and after a turn, the roles whose text is learned, and the moves of a
finite-state machine over roles. Each conversation becomes one formatted string and its segments: header,
text and footer of every turn, with a loss flag each; the segments joined are the formatted string. The
machine's last state tells whether the order of turns is valid.

Texts cannot forge a turn: the control strings and the escape sign are replaced by two-sign codes, and
reading back splits at the footer, which no text can contain.

Defined results: a null text is empty, a null role is the empty role, which no move allows; turns stand by
(turn, role, text) with null turns first, so repeated turns stay and ties have one order; a conversation
with a null conv_id is one conversation; no rows give no conversations; further columns are passed over. A
conversation is one output row, so one task holds one conversation, never several.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldflow.llm import frames

MOVES = {
    "start": {"system": "briefed", "user": "asked"},
    "briefed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}


@dataclass(frozen=True)
class Template:
    mark: str = "### "  # before a turn's role
    colon: str = ": "  # between role and text
    footer: str = "\n</turn>\n"
    controls: dict = field(default_factory=lambda: {"###": "h", "</turn>": "t"})
    role_controls: dict = field(default_factory=lambda: {"###": "h", "</turn>": "t", ": ": "c"})
    learned: tuple = ("assistant",)
    moves: dict = field(default_factory=lambda: MOVES)
    accepts: tuple = ("asked", "answered")


def escape(text: Column, controls: dict) -> Column:
    """Doubles the escape sign, then replaces every control string by its code; ``unescape`` undoes it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, code in controls.items():
        text = F.replace(text, F.lit(control), F.lit("\\" + code))
    return text


def unescape(text: Column, controls: dict) -> Column:
    """Codes stand between doubled signs: cut there, put control strings back, join by single signs."""

    def back(part: Column) -> Column:
        for control, code in controls.items():
            part = F.replace(part, F.lit("\\" + code), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), back), "\\")


def _state(roles: Column, template: Template) -> Column:
    """The machine's state after all roles; a move it does not have ends in "rejected"."""
    moves = [F.lit(x) for s, by in template.moves.items() for r, to in by.items() for x in (f"{s}>{r}", to)]
    table = F.create_map(*moves)
    step = lambda state, role: F.coalesce(table[F.concat(state, F.lit(">"), role)], F.lit("rejected"))
    return F.aggregate(roles, F.lit("start"), step)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, state, valid, segments (text, loss) and formatted, one row per conversation."""
    turns = frames.pick(conversations, conv_id="long", turn="long", role="string", text="string")
    turns = turns.fillna("", ["role", "text"]).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )

    def segments(turn: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        header = F.concat(F.lit(template.mark), escape(turn["role"], template.role_controls), F.lit(template.colon))
        return F.array(
            piece(header, F.lit(False)),
            piece(escape(turn["text"], template.controls), turn["role"].isin(*template.learned)),
            piece(F.lit(template.footer), F.lit(False)),
        )

    state = _state(F.col("turns.role"), template)
    made = turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        state.alias("state"),
        F.flatten(F.transform("turns", segments)).alias("segments"),
    )
    return made.select(
        "conv_id",
        "n_turns",
        "state",
        F.col("state").isin(*template.accepts).alias("valid"),
        "segments",
        F.array_join("segments.text", "").alias("formatted"),
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``turns`` (role, text) parsed from the formatted string, and ``loss_text`` from the flagged segments."""
    footer = "".join(f"\\{c}" if c in "\\^$.|?*+()[]{}/" else c for c in template.footer)
    pieces = F.split("formatted", footer, -1)

    def turn(piece: Column) -> Column:
        # An escaped role cannot hold the colon, so the first one ends it.
        colon = F.call_function("locate", F.lit(template.colon), piece)
        role = F.substring(piece, F.lit(len(template.mark) + 1), colon - len(template.mark) - 1)
        text = F.substring(piece, colon + len(template.colon), F.length(piece))
        return F.struct(unescape(role, template.role_controls).alias("role"), unescape(text, template.controls).alias("text"))

    learned = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template.controls))
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(learned, "")})
