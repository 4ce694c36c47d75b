"""Chat formatting in DataFrame expressions: turns collected, sorted, merged by role and concatenated.

A formatted conversation is a row of blocks ``<|role|>text<|end|>``. Turns of one role in a
row share a block, with ``<|and|>`` between their texts, so the turns can be read back.
Inside texts and roles a backslash is doubled, and one is put after the first character
of everything that this or a common other template takes for control, so no text can
open or close a block; inside roles also within ``|>``, so no role can end early.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END, AND = "<|end|>", "<|and|>"
#: Beginnings of control strings: <| of this template, <s> </s> [INST] [/INST] <<SYS>> of others.
_CONTROL = r"<(?=\|)|<(?=/?s>)|\[(?=/?INST\])|<(?=<?/?SYS>)|<(?=</SYS>)"
_TURNS = "array<struct<role:string,text:string>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def escaped_role(role: Column) -> Column:
    """As a text, and with a backslash inside ``|>``, which would end the role."""
    return F.regexp_replace(escaped(role), r"\|(?=>)", r"|\\")


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"\|\\(?=>)", "|"))


def unescaped(text: Column) -> Column:
    """Takes away the lone backslash after < or [ and halves the doubled ones."""
    return F.replace(F.regexp_replace(text, r"([<\[])\\(?!\\)", "$1"), F.lit("\\\\"), F.lit("\\"))


def _merged(turns: Column) -> Column:
    """Blocks ``(role, texts)``: adjacent turns of one role together.

    The places at which the role changes cut the array into slices.
    """
    changes = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (
        F.element_at(turns, i)["role"] != F.element_at(turns, F.greatest(i - 1, F.lit(1)))["role"]))
    ends = F.concat(F.slice(changes, F.lit(2), F.size(changes)), F.array(F.size(turns) + 1))
    return F.zip_with(changes, ends, lambda a, b: F.struct(
        F.element_at(turns, a)["role"].alias("role"),
        F.transform(F.slice(turns, a, b - a), lambda t: t["text"]).alias("texts")))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, mask)`` per conversation.

    ``mask``: ``(start, length)`` in characters, from 1, of each text of a trained role in
    ``formatted``. Turns stand by number, then role, then text; a null number
    comes first, a null text is empty and a null role is the empty role. Rows without a
    conversation id form one conversation with a null id. No rows give no rows.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    sorted_ = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    plain = sorted_.select("conv_id", F.transform("turns", lambda t: F.struct(
        escaped_role(t["role"]).alias("role"), escaped(t["text"]).alias("text"))).alias("turns"))
    blocks = plain.select("conv_id", _merged(F.col("turns")).alias("blocks"))
    # Pieces of the output in order; a piece of a trained text has its flag set.
    pieces = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit("<|"), b["role"], F.lit("|>")).alias("s"), F.lit(False).alias("f"))),
        F.flatten(F.transform(b["texts"], lambda x, i: F.array(
            F.struct(F.when(i > 0, F.lit(AND)).otherwise("").alias("s"), F.lit(False).alias("f")),
            F.struct(x.alias("s"), b["role"].isin(*trained).alias("f"))))),
        F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("f")))))).alias("pieces"))
    lengths = pieces.withColumn("upto", F.transform("pieces", lambda p: F.char_length(p["s"]).cast("long")))
    # Where pieces begin, by one pass over the lengths.
    starts = F.aggregate(
        "upto", F.struct(F.lit(1).cast("long").alias("next"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, n: F.struct((acc["next"] + n).alias("next"), F.concat(acc["all"], F.array(acc["next"])).alias("all")),
        lambda acc: acc["all"])
    marked = lengths.withColumn("starts", starts)
    return marked.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.filter(F.zip_with(F.arrays_zip("starts", "upto"), "pieces", lambda n, p: F.when(p["f"], F.struct(
            n["starts"].alias("start"), n["upto"].alias("length")))), lambda x: x.isNotNull()).alias("mask"))


def parsed_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, as they were given."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda b: b != "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(
        F.split(F.regexp_extract(b, r"(?s)^<\|.*?\|>(.*)$", 1), r"<\|and\|>", -1),
        lambda x: F.struct(unescaped_role(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
                           unescaped(x).alias("text")))))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the mask."""
    return F.transform(mask, lambda m: unescaped(F.substring(formatted, m["start"].cast("int"), m["length"].cast("int"))))
