"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted; adjacent turns of one role form one block. A block is
``<|im_start|>role\\ntext<|im_end|>\\n``; texts of merged turns are parted by ``<|im_sep|>``. Inside roles and texts
``&`` becomes ``&amp;`` and ``<|`` becomes ``&lt;|`` (and a role's line break ``&nl;``), so no text can hold a control
string and each is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SEP = "<|im_start|>", "<|im_end|>\n", "<|im_sep|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per conversation: conv_id, formatted, loss_mask.

    ``loss_mask`` lists (start, length) in code points of every assistant text in ``formatted``, from 0. Turns sort by
    number (nulls first), ties by role and text. A null role or text counts as empty; rows of a null conv_id form one
    conversation; repeated rows are turns of their own; other columns are not read; an empty table gives no rows. A
    conversation is one output row, so its turns meet in one task; there is no limit on their number.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    one = F.struct("turn", role.alias("role"), text.alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def part(t: Column, i: Column) -> Column:
        """What stands before a turn's text (a new block, or the parting mark if the role stays), and the text."""
        same = F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))
        new = F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(START), escape_role(t["role"]), F.lit("\n"))
        return F.struct(F.when(same, F.lit(SEP)).otherwise(new).alias("head"), escape(t["text"]).alias("body"), (t["role"] == TRAINED).alias("trained"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def span(acc: Column, p: Column) -> Column:
        start, n = acc["at"] + F.length(p["head"]), F.length(p["body"])
        own = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct((start + n).alias("at"), F.when(p["trained"], F.concat(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    parts = talks.select("conv_id", F.transform("turns", part).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"])), "")
    return parts.select("conv_id", F.concat(text, F.lit(END)).alias("formatted"), F.aggregate("parts", nothing, span)["mask"].alias("loss_mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Read turns and trained-on text back from ``formatted`` and ``loss_mask`` alone: conv_id, turns
    (array of role and text), loss_text, formatted, and n_blocks (same-role runs)."""
    blocks = F.split(F.expr(f"substring(formatted, 1, length(formatted) - {len(END)})"), _quoted(END))

    def turns_of(block: Column) -> Column:
        cut = F.instr(block, "\n")
        role = unescape_role(F.substring(block, F.lit(len(START) + 1), cut - len(START) - 1))
        body = F.substring(block, cut + 1, F.length(block))
        return F.transform(F.split(body, _quoted(SEP)), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, turns_of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        "formatted",
        F.size(blocks).cast("long").alias("n_blocks"),
    )


def _quoted(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def chat_report(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks; all read back from the
    formatted string. Rules of ``format_chats``."""
    back = read_chats(format_chats(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
