r"""Chat formatting from an event log (operator 1).

The log of a conversation is sorted by sequence and folded: ``message`` opens a
turn, ``delta`` appends streamed text, ``edit`` replaces the turn's text and
``regenerate`` replaces it and withdraws all later turns.  The final messages
are rendered with control strings; the same strings inside a text get a
backslash after their first character (one more if there are some already),
which ``unescape`` takes away again.

Template: ``<<SYS>>system<</SYS>>``, ``[INST]user[/INST]``, ``<s>assistant</s>``;
any other role is ``<<ROLE=name>>text<</ROLE>>`` with the name URL-encoded.

Null text is empty, a null kind is ``message``, a null role is the empty role.
Events that tie on the sequence are taken in order of kind, role and text.
Other columns are ignored; a conversation without events has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The control strings of the template.
OPENING = {"system": "<<SYS>>", "user": "[INST]", "assistant": "<s>"}
CLOSING = {"system": "<</SYS>>", "user": "[/INST]", "assistant": "</s>"}
OTHER_OPENING, OTHER_CLOSING = ("<<ROLE=", ">>"), "<</ROLE>>"

_REST = r"(/?s>|/?INST\]|</?SYS>>|<ROLE=|</ROLE>>)"
_SEGMENT = r"(?s)(?:<s>|\[INST\]|<<SYS>>|<<ROLE=[^>]*>>).*?(?:</s>|\[/INST\]|<</SYS>>|<</ROLE>>)"
_PARTS = r"(?s)^(<s>|\[INST\]|<<SYS>>|<<ROLE=[^>]*>>)(.*)(?:</s>|\[/INST\]|<</SYS>>|<</ROLE>>)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text)."""
    log = events.select(
        "conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.col("seq"), F.col("kind"), F.col("role"), F.col("text")]
    after = Window.partitionBy("conv_id").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("conv_id", "turn").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    restarts = F.col("kind") != "delta"
    return (
        log.withColumn("_withdrawn", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(after))
        .filter("_withdrawn IS NULL OR turn <= _withdrawn")
        .withColumn("_replaced", F.coalesce(F.max(restarts).over(so_far), F.lit(False)))
        .filter("NOT _replaced")
        .groupBy("conv_id", "turn")
        .agg(
            F.max_by("role", F.struct("seq", "kind", "role", "text")).alias("role"),
            F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("_parts"),
        )
        .select("conv_id", "turn", "role", F.array_join("_parts.text", "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """One row per message: its piece of the output and the span of the piece under the loss mask."""
    role = F.col("role")

    def pick(strings: dict[str, str], other: Column) -> Column:
        out = other
        for name, value in strings.items():
            out = F.when(role == name, F.lit(value)).otherwise(out)
        return out

    opening = pick(OPENING, F.concat(F.lit(OTHER_OPENING[0]), F.url_encode(role), F.lit(OTHER_OPENING[1])))
    learnt = role == "assistant"
    return (
        messages.withColumns({"_opening": opening, "_body": escape(F.col("text"))})
        .select(
            "conv_id", "turn",
            F.concat("_opening", "_body", pick(CLOSING, F.lit(OTHER_CLOSING))).alias("piece"),
            F.when(learnt, F.char_length("_opening")).otherwise(0).alias("loss_start"),
            F.when(learnt, F.char_length("_body")).otherwise(0).alias("loss_length"),
        )
    )


def assemble(pieces: DataFrame) -> DataFrame:
    """One row per conversation: the formatted text and its pieces with their loss spans."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "piece", "loss_start", "loss_length")))
    return pieces.groupBy("conv_id").agg(ordered.alias("pieces")).withColumn("formatted", F.array_join("pieces.piece", ""))


def format_conversations(events: DataFrame) -> DataFrame:
    """Fold, render and join: (conv_id, pieces, formatted)."""
    return assemble(render(fold(events)))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) parsed from a formatted text."""
    parts = F.regexp_extract_all(formatted, F.lit(_SEGMENT), F.lit(0))

    def turn(segment: Column) -> Column:
        opening = F.regexp_extract(segment, _PARTS, 1)
        role = F.url_decode(F.regexp_extract(opening, "^<<ROLE=([^>]*)>>$", 1))
        for name, value in OPENING.items():
            role = F.when(opening == value, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_extract(segment, _PARTS, 2)).alias("text"))

    return F.transform(parts, turn)


def loss_text(pieces: Column) -> Column:
    """Unescaped text under the loss mask, in order."""
    marked = F.filter(pieces, lambda p: p["loss_length"] > 0)
    return F.array_join(
        F.transform(marked, lambda p: unescape(F.substring(p["piece"], p["loss_start"] + 1, p["loss_length"]))), ""
    )
