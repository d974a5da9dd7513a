"""Chat formatting with DataFrame expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), adjacent turns of one
role become one block (array slices joined), and the blocks are concatenated.

Template: ``<s>`` then blocks; a user block is ``[INST]..[/INST]``, an assistant block ``[OUT]..</s>``,
any other role ``[ROLE]name[BODY]..[/ROLE]``; ``[TURN]`` stands between turns of one block.  A control
string inside a text or a role name gets a backslash after its first character (one more if it has some
already), which ``unescape`` takes away, so the turns can be read back exactly.

Defined cases: null text or role: empty.  A null ``conv_id`` is a conversation of its own; a null
``turn`` sorts first.  Repeated rows stay, in sorted order.  No rows: no conversations.  Other columns
of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = "s>|INST\\]|OUT\\]|ROLE\\]|BODY\\]|TURN\\]"
ESCAPE = f"([\\[<])(\\\\*)(?=/?(?:{NAMES}))"
UNESCAPE = f"([\\[<])\\\\(\\\\*)(?=/?(?:{NAMES}))"
BLOCK = "(?s)(?:\\[INST\\].*?\\[/INST\\]|\\[OUT\\].*?</s>|\\[ROLE\\].*?\\[/ROLE\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "$1\\\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2")


def opening(role: Column) -> Column:
    return F.when(role == "user", F.lit("[INST]")).when(role == "assistant", F.lit("[OUT]")).otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[BODY]")))


def closing(role: Column) -> Column:
    return F.when(role == "user", F.lit("[/INST]")).when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted`` and ``loss_spans`` (start and length in code points
    of ``formatted``: the assistants' escaped texts, one span a turn)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    at = lambda i: F.get(F.col("turns"), i)
    n = F.size("turns")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (at(i - 1)["role"] != at(i)["role"]))
    blocks = F.transform(
        "first",
        lambda s, k: F.struct(
            at(s)["role"].alias("role"),
            F.transform(F.slice("turns", s + 1, F.coalesce(F.get(F.col("first"), k + 1), n) - s), lambda t: escape(t["text"])).alias("texts"),
        ),
    )
    step = lambda acc, b: F.struct(
        (acc["at"] + F.length(opening(b["role"])) + F.aggregate(b["texts"], F.lit(0), lambda a, t: a + F.length(t)) + 6 * (F.size(b["texts"]) - 1) + F.length(closing(b["role"]))).alias("at"),
        F.when(b["role"] == "assistant", F.concat(acc["spans"], spans_of(b, acc["at"] + 5))).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(3).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return (
        turns.withColumn("first", first)
        .select("conv_id", blocks.alias("blocks"))
        .select(
            "conv_id",
            F.concat(F.lit("<s>"), F.array_join(F.transform("blocks", lambda b: F.concat(opening(b["role"]), F.array_join(b["texts"], "[TURN]"), closing(b["role"]))), "")).alias("formatted"),
            F.aggregate("blocks", start, step)["spans"].alias("loss_spans"),
        )
    )


def spans_of(block: Column, start: Column) -> Column:
    """Spans of a block's texts; each is followed by the six characters of ``[TURN]``."""
    first = F.struct(start.alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("spans"))
    return F.aggregate(
        block["texts"],
        first,
        lambda a, t: F.struct((a["at"] + F.length(t) + 6).alias("at"), F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.length(t).alias("length")))).alias("spans")),
    )["spans"]


def parse_chats(formatted: DataFrame) -> DataFrame:
    """The inverse of ``format_chats``: adds ``turns`` (role, text) and ``loss_texts``, read from ``formatted``."""
    blocks = F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0))

    def role(b: Column) -> Column:
        return F.when(F.startswith(b, F.lit("[INST]")), F.lit("user")).when(F.startswith(b, F.lit("[OUT]")), F.lit("assistant")).otherwise(unescape(F.substring_index(F.substr(b, F.lit(7)), "[BODY]", 1)))

    def body(b: Column) -> Column:
        inst = F.substr(b, F.lit(7), F.length(b) - 13)
        out = F.substr(b, F.lit(6), F.length(b) - 9)
        named = F.substr(b, F.instr(b, "[BODY]") + 6, F.length(b) - F.instr(b, "[BODY]") - 12)
        return F.when(F.startswith(b, F.lit("[INST]")), inst).when(F.startswith(b, F.lit("[OUT]")), out).otherwise(named)

    turns = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), "\\[TURN\\]"), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": turns, "loss_texts": loss})
