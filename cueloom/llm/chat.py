"""Chat formatting with column functions only: a finite-state machine over roles and a template.

The template is declarative: marker strings, a transition table ``(state, role) -> state`` and the
roles that carry loss.  Every turn becomes three segments (opening, body, closing) with a loss flag;
only bodies of loss roles carry one, so the text under the mask is exactly those bodies.

Control strings inside texts are escaped reversibly: every ``<`` followed by backslashes and ``|``
gains one backslash, so no text contains the two characters that start a marker.  Roles are escaped
the same way, with ``%`` and line feeds percent-coded.

Defined cases: null text and null role are empty strings; null conversation ids form one
conversation; turns sort by (turn, role, text) with null turns first, so ties are ordered and rows
equal in all three are interchangeable; a turn without a transition sends the machine to
``invalid``, where it stays, and ``first_bad`` is that turn's position; such a conversation is
formatted all the same.  An empty table gives no rows; other columns are ignored.

A conversation is one output row, so its turns meet in one task, sorted on disk if need be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class ChatTemplate:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    initial: str = "begin"
    accepting: tuple[str, ...] = ("answered",)
    transitions: tuple[tuple[str, str, str], ...] = (
        ("begin", "system", "instructed"),
        ("begin", "user", "asked"),
        ("instructed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
    )


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _ordered(conversations: DataFrame, template: ChatTemplate) -> DataFrame:
    """One row per turn: position, the three pieces and the loss flag."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("at"),
        "role",
        F.concat(F.lit(template.start), escape_role(F.col("role")), F.lit(template.after_role)).alias("opening"),
        escape(F.col("text")).alias("body"),
        F.lit(template.end + template.after_turn).alias("closing"),
        F.col("role").isin(*template.loss_roles).alias("loss"),
    )


def _final(roles: Column, template: ChatTemplate) -> Column:
    """Run the machine over the roles: (state, position reached, first position without a transition)."""
    table = F.create_map(*[F.lit(x) for s, r, to in template.transitions for x in (f"{s}|{r}", to)])
    begin = F.struct(
        F.lit(template.initial).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("bad")
    )

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.try_element_at(table, F.concat(acc["state"], F.lit("|"), role)), F.lit("invalid"))
        bad = F.when(acc["bad"].isNull() & (to == "invalid"), acc["at"]).otherwise(acc["bad"])
        return F.struct(to.alias("state"), (acc["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, begin, step)


def segments(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, segment, role, text, loss): the emitted pieces in order, three for each turn."""
    pieces = F.array(
        F.struct(F.col("opening").alias("text"), F.lit(False).alias("loss")),
        F.struct(F.col("body").alias("text"), F.col("loss").alias("loss")),
        F.struct(F.col("closing").alias("text"), F.lit(False).alias("loss")),
    )
    rows = _ordered(conversations, template).select("conv_id", "at", "role", F.posexplode(pieces).alias("k", "piece"))
    return rows.select("conv_id", (F.col("at") * 3 + F.col("k")).alias("segment"), "role", "piece.text", "piece.loss")


def format_chat(conversations: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: ``formatted`` text, ``loss_spans`` (start, length in code points),
    the machine's final ``state``, ``valid`` (no bad turn and an accepting state) and ``first_bad``."""
    turns = _ordered(conversations, template).withColumn("whole", F.concat("opening", "body", "closing"))
    before = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn(
        "starts", F.coalesce(F.sum(F.char_length("whole")).over(before), F.lit(0)) + F.char_length("opening")
    ).withColumn("span", F.struct(F.col("starts").alias("start"), F.char_length("body").cast("long").alias("length")))
    rows = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "whole", "loss", "span"))).alias("turns")
    )
    out = rows.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["whole"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["span"]).alias("loss_spans"),
        _final(F.transform("turns", lambda t: t["role"]), template).alias("run"),
    )
    return out.select(
        "conv_id", "formatted", "loss_spans", F.col("run.state").alias("state"),
        (F.col("run.bad").isNull() & F.col("run.state").isin(*template.accepting)).alias("valid"),
        F.col("run.bad").alias("first_bad"),
    )


def read_turns(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The (role, text) turns of a formatted conversation, unescaped."""
    blocks = F.split(formatted, r"\Q" + template.end + template.after_turn + r"\E")

    def turn(block: Column) -> Column:
        inner = F.substr(block, F.lit(len(template.start) + 1))
        at = F.position(F.lit(template.after_role), inner)
        return F.struct(
            unescape_role(F.substr(inner, F.lit(1), at - 1)).alias("role"),
            unescape(F.substr(inner, at + len(template.after_role))).alias("text"),
        )

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
