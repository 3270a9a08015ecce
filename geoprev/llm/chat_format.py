"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

Every conversation becomes a list of text segments, each with a loss flag; the formatted text is their
concatenation. Control strings inside texts are escaped reversibly: backslashes are doubled, and a
backslash goes behind the first character of each control string, so a formatted text contains control
strings only where the template put them. `read_back` inverts the format from the formatted text alone.

A conversation is the unit: its turns meet in one row (longest wins memory, other conversations are
independent). Defined results: rows are ordered by turn, then role, then text; null text and null role
count as empty; repeated rows are kept; a role that the template does not know is written like a turn
without loss and makes the conversation invalid; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is written head + role + mid + escaped text + tail. transitions: (state, role) to state."""

    head: str = "<|turn|>"
    mid: str = "<|text|>"
    tail: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    transitions: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    #: Strings of other formats that must not survive inside a text either.
    reserved: tuple[str, ...] = ("</s>", "[INST]", "[/INST]")

    @property
    def controls(self) -> list[str]:
        return [self.head, self.mid, self.tail.rstrip("\n"), *self.reserved]

    def __post_init__(self) -> None:
        for a in self.controls:
            for b in self.controls:
                if len(a) < 2 or "\\" in a or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))) or (a != b and a in b):
                    raise ValueError(f"control strings overlap or are too short: {a!r}, {b!r}")


def escape(c: Column, t: Template) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in t.controls:
        c = F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}"))
    return c


def unescape(c: Column, t: Template) -> Column:
    for s in t.controls:
        c = F.replace(c, F.lit(f"{s[0]}\\{s[1:]}"), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def format_chats(df: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted, state, valid."""
    e = F.lit("")
    turns = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", e).alias("role"), F.coalesce("text", e).alias("text")))).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.transitions.items() for x in (f"{state}\x00{role}", to)])
    step = lambda state, x: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\x00"), x["role"])), F.lit("invalid"))
    seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        seg(F.concat(F.lit(t.head), escape(x["role"], t), F.lit(t.mid)), no),
        seg(escape(x["text"], t), x["role"].isin(*t.loss_roles)),
        seg(F.lit(t.tail), no))))
    return turns.select(
        "conv_id", segments.alias("segments"),
        F.aggregate("turns", F.lit(t.start), step).alias("state"),
    ).select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
             "state", F.col("state").isin(*t.accept).alias("valid"))


def read_back(formatted: Column, t: Template = Template()) -> Column:
    """array<struct<role, text>> from a formatted text."""
    pieces = F.filter(F.split(formatted, "\\Q" + t.head + "\\E"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, t.mid, 1), t).alias("role"),
        unescape(F.substring_index(F.substring_index(p, t.mid, -1), t.tail.rstrip("\n"), 1), t).alias("text")))
