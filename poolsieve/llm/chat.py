"""Chat formatting that a parser can undo.

Grammar of the rendered text:

    conversation := turn*
    turn := "<s>[INST]" text "[/INST]"                  user
          | "<s>[ANS]" text "</s>"                      assistant
          | "<s>[SYS]" text "[/SYS]"                    system
          | "<s>[ROLE]" role "[TEXT]" text "[/ROLE]"    any other role

A text or role may not hold one of the control strings.  Where it would, a
backslash goes behind the first character of the string; where backslashes
already stand there, one more.  Taking one away undoes that, so no text is
changed by the way through, and texts without such strings are left as they
are.

Every conversation is rendered plainly and parsed; if the recovered turns are
not the source's, it is rendered with its conflicting texts escaped and parsed
again, which by the rule above recovers them; if it did not, the job would fail.

Everything is SQL expressions over one row for each conversation.

Turns are in order of ``turn``, ties by role and text; a null turn comes first.
Null roles and texts are empty.  Rows with a null id are one conversation.  Rows
that repeat are turns each.  Texts are formatted whole, however long; a
conversation is one value, so it has to fit one.  An empty table gives an empty
result.  Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUNDS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>"), "system": ("[SYS]", "[/SYS]")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
START = "<s>"
#: What follows the first character of a control string, as a pattern.
_TAILS = r"(/?s>|/?INST\]|ANS\]|/?SYS\]|/?ROLE\]|TEXT\])"
_CONTROL = r"[<\[]" + _TAILS


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, "$1$2$3")


def _turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(START + OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (a, z) in BOUNDS.items():
        out = F.when(role == name, F.concat(F.lit(START + a), text, F.lit(z))).otherwise(out)
    return out


def render(turns: Column, escaped: bool) -> Column:
    """The text of ``array<struct<role, text>>``."""
    if escaped:
        return F.array_join(F.transform(turns, lambda t: _turn(F.when(t["role"].isin(*BOUNDS), t["role"]).otherwise(escape(t["role"])), escape(t["text"]))), "")
    return F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["text"])), "")


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def _split(formatted: Column) -> Column:
    """Role, raw text, and where the raw text begins in its turn; a turn that the grammar lacks has a null role."""

    def one(turn: Column) -> Column:
        role = text = F.lit(None).cast("string")
        at = F.lit(None).cast("int")
        pattern = f"(?s)^{_quoted(OTHER[0])}(.*){_quoted(OTHER[1])}(.*){_quoted(OTHER[2])}$"
        other = F.regexp_extract(turn, pattern, 1)
        fits = F.regexp_like(turn, F.lit(pattern)) & ~other.isin(*BOUNDS)
        role = F.when(fits & ~F.regexp_like(other, F.lit(_CONTROL)), other)
        text = F.when(fits, F.regexp_extract(turn, pattern, 2))
        at = F.when(fits, F.length(other) + len(OTHER[0]) + len(OTHER[1]))
        for name, (a, z) in BOUNDS.items():
            pattern = f"(?s)^{_quoted(a)}(.*){_quoted(z)}$"
            mine = F.regexp_like(turn, F.lit(pattern))
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, F.regexp_extract(turn, pattern, 1)).otherwise(text)
            at = F.when(mine, F.lit(len(a))).otherwise(at)
        role = F.when(~F.regexp_like(text, F.lit(_CONTROL)), role)
        return F.struct(role.alias("role"), text.alias("raw"), at.alias("at"), F.length(turn).alias("size"))

    pieces = F.split(formatted, _quoted(START))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one)


def parse(formatted: Column) -> Column:
    """The turns of a rendered text, ``array<struct<role, text>>``; outside the grammar, turns with nulls."""
    known = lambda role: F.when(role.isin(*BOUNDS), role).otherwise(unescape(role))
    return F.transform(_split(formatted), lambda t: F.struct(known(t["role"]).alias("role"), F.when(t["role"].isNotNull(), unescape(t["raw"])).alias("text")))


def _mask(formatted: Column) -> Column:
    """Spans of the assistants' texts, as rendered: first character from 0, and characters."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<first: int, chars: int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + len(START) + t["at"]
        here = F.array(F.struct(first.cast("int").alias("first"), F.length(t["raw"]).alias("chars")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], here)).otherwise(acc["spans"])
        return F.struct((acc["at"] + len(START) + t["size"]).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(_split(formatted), zero, step)["spans"]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for every conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = F.transform(F.sort_array(F.collect_list(row)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    source = conversations.groupBy("conv_id").agg(turns.alias("turns"))
    plain = source.withColumn("plain", render(F.col("turns"), False))
    same = parse(F.col("plain")).eqNullSafe(F.col("turns"))
    text = plain.withColumn("formatted", F.when(same, F.col("plain")).otherwise(render(F.col("turns"), True)))
    failed = F.raise_error(F.concat(F.lit("a conversation does not survive formatting: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    checked = text.withColumn("formatted", F.when(parse(F.col("formatted")).eqNullSafe(F.col("turns")), F.col("formatted")).otherwise(failed.cast("string")))
    return checked.select("conv_id", "formatted").withColumn("loss_spans", _mask(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the formatted text."""
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["first"] + 1, s["chars"]))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumn("loss", loss)
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
