"""Chat formatting (operator 9), in DataFrame functions only.

A declarative template gives the marks around a turn, the roles that carry loss
and the transitions of a finite-state machine over roles.  Every turn is formatted
where it lies; a conversation then only collects its finished segments in order.

Marks inside texts and roles are escaped letter by letter (the escape letter
first), which `unescape` undoes exactly.  Null texts and roles count as empty;
repeated turns stay, in a fixed order; a role that the machine does not know, or
a turn out of order, leaves the conversation formatted, with `valid` false and
`first_error` at the turn's place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks, loss and turn order; `escapes` maps letters of the marks to what stands for them in texts."""

    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple = ("assistant",)
    escapes: tuple = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
    start: str = "start"
    order: dict = field(default_factory=lambda: {
        ("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
        ("asked", "assistant"): "ready",
    })


def escape(text: Column, t: Template) -> Column:
    for plain, coded in t.escapes:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column, t: Template) -> Column:
    for plain, coded in reversed(t.escapes):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _machine(roles: Column, t: Template) -> Column:
    """Place of the first turn out of order, or 0."""
    pairs = [x for (state, role), to in t.order.items() for x in (F.lit(f"{state}\x00{role}"), F.lit(to))]
    moves = F.create_map(*pairs)
    none = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(0).alias("bad"))

    def step(a, role):
        to = F.element_at(moves, F.concat(a["state"], F.lit("\x00"), role))
        return F.struct(
            F.coalesce(to, a["state"]).alias("state"), (a["n"] + 1).alias("n"),
            F.when(to.isNull() & (a["bad"] == 0), a["n"] + 1).otherwise(a["bad"]).alias("bad"),
        )

    return F.aggregate(roles, none, step, lambda a: a["bad"])


def format_chats(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, segments (array of text and loss), valid, first_error."""
    t = template
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = df.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), who.alias("r"),
        F.concat(F.lit(t.head), escape(who, t), F.lit(t.colon)).alias("h"), escape(said, t).alias("x"), who.isin(*t.loss_roles).alias("l"),
    )
    grouped = rows.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "r", "x", "h", "l"))).alias("rows"))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("rows", lambda x: F.array(segment(x["h"], F.lit(False)), segment(x["x"], x["l"]), segment(F.lit(t.end), F.lit(False)))))
    bad = _machine(F.transform("rows", lambda x: x["r"]), t)
    out = grouped.select(F.col("c").alias(conv), F.size("rows").cast("bigint").alias("n_turns"), segments.alias("segments"), bad.alias("first_error"))
    return out.select(
        conv, "n_turns", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        (F.col("first_error") == 0).alias("valid"), "first_error",
    )


def read_back(df: DataFrame, template: Template = Template()) -> DataFrame:
    """format_chats()'s rows with `turns` (array of role and text) parsed from `formatted`, and `loss_text` from the mask."""
    t = template
    parts = F.filter(F.split(F.col("formatted"), F.lit("\\Q" + t.end + "\\E")), lambda p: p != "")

    def turn(p):
        body = F.substring(p, F.lit(len(t.head) + 1), F.length(p))
        at = F.locate(t.colon, body)
        return F.struct(
            unescape(F.substring(body, F.lit(1), at - 1), t).alias("role"),
            unescape(F.substring(body, at + len(t.colon), F.length(body)), t).alias("text"),
        )

    kept = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t))
    return df.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(kept, ""))


def digests(df: DataFrame, template: Template = Template(), conv: str = "conv_id") -> DataFrame:
    """What read_back() finds, as counts and digests."""
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read_back(df, template).select(
        conv, F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "first_error",
    )
