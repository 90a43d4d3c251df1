"""Chat formatting as a relational job: sort collected turn structs, merge adjacent turns of a role, concatenate.

Template, one message after another::

    <|im_start|>role\\ntext<|turn|>text<|im_end|>\\n

``<|turn|>`` parts the texts of adjacent turns that one message merges. All control strings begin with ``<|``; inside
texts and roles a ``<``, any number of backslashes and a ``|`` get one backslash more, which is reversible and leaves no
``<|`` behind. Roles also have ``%`` and line feeds percent-encoded, since a line feed ends them.

Turns are collected in two steps, by conversation and run of turn numbers and then by conversation, so a conversation
of very many turns is sorted and escaped by several tasks before its parts meet.

Defined results: null texts and roles are empty; turns with the same number follow by role, then text; turns without a
number come first; repeated rows are turns of their own; a null conversation id is a conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(turns: DataFrame, run: int = 256) -> DataFrame:
    """One row per conversation: conv_id, ``formatted`` and ``segments``, the same string as an array of
    (text, loss): loss is true for the escaped texts of assistant turns and for nothing else.

    turns: conv_id, turn, role, text; further columns are ignored. run: turn numbers that one collecting task handles.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    struct = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    parts = (
        turns.select("conv_id", F.floor(F.col("turn") / run).alias("part"), struct.alias("t"))
        .groupBy("conv_id", "part")
        .agg(F.array_sort(F.collect_list("t")).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"))))
    )
    chats = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "turns"))).alias("parts"))
    chats = chats.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"))
    turn_at = lambda i: F.element_at(F.col("turns"), i)
    firsts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (turn_at(i)["role"] != F.get(F.col("turns"), i - 2)["role"]))
    chats = chats.withColumn("firsts", firsts)
    ends = lambda k: F.coalesce(F.get(F.col("firsts"), k + 1), F.size("turns") + 1)
    messages = F.transform("firsts", lambda i, k: F.struct(turn_at(i)["role"].alias("role"), F.transform(F.slice(F.col("turns"), i, ends(k) - i), lambda t: t["text"]).alias("texts")))
    chats = chats.select("conv_id", messages.alias("messages"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def segments(m: Column) -> Column:
        inner = F.flatten(
            F.transform(
                m["texts"],
                lambda x, i: F.array(
                    piece(F.when(i == 0, F.concat(F.lit(START), m["role"], F.lit("\n"))).otherwise(F.lit(TURN)), F.lit(False)),
                    piece(x, m["role"] == "assistant"),
                ),
            )
        )
        return F.concat(inner, F.array(piece(F.lit(END + "\n"), F.lit(False))))

    chats = chats.select("conv_id", F.flatten(F.transform("messages", segments)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string, unescaped, in order."""
    quoted = lambda s: s.replace("|", r"\|")
    messages = F.slice(F.split(formatted, quoted(START)), F.lit(2), F.greatest(F.size(F.split(formatted, quoted(START))) - 1, F.lit(0)))

    def turns(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        body = F.substring_index(F.substr(m, F.length(role) + 2), END, 1)
        return F.transform(F.split(body, quoted(TURN)), lambda x: F.struct(unescaped_role(role).alias("role"), unescaped(x).alias("text")))

    return F.flatten(F.transform(messages, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
