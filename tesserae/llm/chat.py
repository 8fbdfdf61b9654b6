"""Chat formatting: a finite-state machine over roles and a declarative template.

All of it is DataFrame expressions. A conversation's turns are ordered by turn
number, then role and text, nulls first. The machine walks the roles and names
the first turn that has no transition; such conversations are formatted too,
with ``valid`` false. Each turn gives three segments (open mark, text, close
mark), and a loss flag for each comes from the template.

Inside texts and role names every control string of the template is broken up:
the escape character ``\\`` becomes ``\\\\`` and the first character of a
control string becomes a backslash and its letter. An escaped text holds no
control string, so the formatted string can be cut at the marks and read back.

Defined cases: null text is empty; a null role is written as ``\\N`` and read
back as null; null conversation ids make one conversation of their own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks, control strings, loss flags and turn order of a chat format.

    ``open_mark`` + role + ``role_end`` starts a turn and ``close_mark`` ends it.
    ``controls`` are strings that texts may not hold verbatim; the marks among
    them. ``letters`` names the first character of each. ``loss`` gives the
    flags of (open mark, text, close mark) by role, else none. ``moves`` are the
    machine's transitions (state, role) -> state; ``finals`` the accepting ones.
    """

    open_mark: str = "<|im_start|>"
    role_end: str = "\n"
    close_mark: str = "<|im_end|>"
    controls: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>")
    letters: dict[str, str] = field(default_factory=lambda: {"<": "l", "[": "b"})
    loss: dict[str, tuple[bool, bool, bool]] = field(default_factory=lambda: {"assistant": (False, True, False)})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    finals: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if {self.open_mark, self.close_mark} - set(self.controls):
            raise ValueError("the marks must be control strings")
        if {c[0] for c in self.controls} != set(self.letters) or not all(re.fullmatch("[a-z]", x) and x != "n" for x in self.letters.values()) or len(set(self.letters.values())) < len(self.letters):
            raise ValueError("each control string's first character needs a letter of its own, other than n")


DEFAULT = Template()


def escape(text: Column, template: Template = DEFAULT) -> Column:
    """``text`` without any control string; ``unescape`` gives it back."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for first, letter in template.letters.items():
        rest = "|".join(re.escape(c[1:]) for c in template.controls if c[0] == first)
        out = F.regexp_replace(out, f"{re.escape(first)}(?={rest})", re.escape(ESCAPE) + letter)
    return out


def unescape(text: Column, template: Template = DEFAULT) -> Column:
    """The inverse of ``escape``."""
    # A doubled escape character is held as one that no text can hold unescaped.
    out = F.replace(text, F.lit(ESCAPE * 2), F.lit(ESCAPE + "-"))
    for first, letter in template.letters.items():
        out = F.replace(out, F.lit(ESCAPE + letter), F.lit(first))
    return F.replace(out, F.lit(ESCAPE + "-"), F.lit(ESCAPE))


def escaped_role(role: Column, template: Template = DEFAULT) -> Column:
    return F.coalesce(F.replace(escape(role, template), F.lit(template.role_end), F.lit(ESCAPE + "n")), F.lit(ESCAPE + "N"))


def unescaped_role(role: Column, template: Template = DEFAULT) -> Column:
    safe = F.replace(role, F.lit(ESCAPE * 2), F.lit(ESCAPE + "-"))
    return F.when(role != ESCAPE + "N", unescape(F.replace(F.replace(safe, F.lit(ESCAPE + "n"), F.lit(template.role_end)), F.lit(ESCAPE + "-"), F.lit(ESCAPE * 2)), template))


def _flags(role: Column, part: int, template: Template) -> Column:
    on = [r for r, flags in template.loss.items() if flags[part]]
    return F.coalesce(role.isin(on), F.lit(False)) if on else F.lit(False)


def _first_bad(turns: Column, template: Template) -> Column:
    """Index of the first turn without a transition; the count of turns if only the end is wrong; else null."""
    step = F.lit(None).cast("string")
    zero = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("bad"))

    def move(acc: Column, turn: Column) -> Column:
        to = step
        for (state, role), target in template.moves.items():
            to = F.when((acc["state"] == state) & turn["role"].eqNullSafe(F.lit(role)), F.lit(target)).otherwise(to)
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["n"] + 1).alias("n"), F.coalesce(acc["bad"], F.when(to.isNull(), acc["n"])).alias("bad"))

    def finish(acc: Column) -> Column:
        return F.coalesce(acc["bad"], F.when(~acc["state"].isin(list(template.finals)), acc["n"]))

    return F.aggregate(turns, zero, move, finish)


def format_chats(df: DataFrame, template: Template = DEFAULT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: id, ``formatted``, ``segments`` (text, loss), ``bad_turn``, ``valid``."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))), _by_turn)
    grouped = df.groupBy(F.col(conv)).agg(turns.alias("turns"))

    def segments(t: Column) -> Column:
        parts = (F.concat(F.lit(template.open_mark), escaped_role(t["role"], template), F.lit(template.role_end)), escape(t["text"], template), F.lit(template.close_mark))
        return F.array(*(F.struct(p.alias("text"), _flags(t["role"], k, template).alias("loss")) for k, p in enumerate(parts)))

    out = grouped.select(conv, F.flatten(F.transform("turns", segments)).alias("segments"), _first_bad(F.col("turns"), template).alias("bad_turn"))
    return out.select(conv, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "bad_turn", F.col("bad_turn").isNull().alias("valid"))


def _by_turn(a: Column, b: Column) -> Column:
    """Order of turns: number, role, text; nulls first."""
    out = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        out = F.when(x.eqNullSafe(y), out).when(x.isNull(), F.lit(-1)).when(y.isNull(), F.lit(1)).when(x < y, F.lit(-1)).otherwise(F.lit(1))
    return out


def read_chats(formatted: DataFrame, template: Template = DEFAULT, conv: str = "conv_id") -> DataFrame:
    """Read formatted conversations back: id, ``turns`` (role, text), ``loss_text``, ``formatted``.

    Turns come from cutting the formatted string at its marks; the loss text
    from the segments under the mask, unescaped.
    """
    pieces = F.slice(F.split(F.col("formatted"), re.escape(template.close_mark)), 1, F.size(F.split(F.col("formatted"), re.escape(template.close_mark))) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(template.open_mark) + 1, 2147483647)
        role = F.substring_index(body, template.role_end, 1)
        text = F.substr(body, F.length(role) + len(template.role_end) + 1)
        return F.struct(unescaped_role(role, template).alias("role"), unescape(text, template).alias("text"))

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], template))
    return formatted.select(conv, F.transform(pieces, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")
