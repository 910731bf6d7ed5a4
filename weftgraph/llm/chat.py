"""Chat formatting as a relational job (DataFrame operations only).

Turns are collected per conversation and sorted as structs; adjacent turns of a role become one block; the
text is one concatenation. A loss mask of spans covers what assistants said. A conversation's turns
meet in one row, as its formatted string has to; nothing is grouped by content, so equal
conversations or a very common first turn don't meet.

Template: ``<|turn|>role\\n`` opens a block, ``<|part|>`` divides the turns merged in it, ``<|end|>\\n`` closes
it. Inside roles and texts, ``&`` becomes ``&amp;`` and the first character of every control string a numeric
reference, so no control string of this or other common templates can be forged, and unescaping is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, PART, END = "<|turn|>", "<|part|>", "<|end|>\n"
#: Control strings escaped in texts (fixed values): those that begin with < and those that begin with [.
ANGLE = r"<(?=\|(?:turn|part|end|im_start|im_end|system|user|assistant)\|>|/?s>|<(?:/?SYS)>>)"
SQUARE = r"\[(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), ANGLE, "&#60;"), SQUARE, "&#91;")


def unescape(text: Column) -> Column:
    for code, mark in (("&#91;", "["), ("&#60;", "<"), ("&#10;", "\n"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array of (at, n) in characters of ``formatted``).

    Turns go by turn (null first), ties by role, then text. A null role or text is empty. A turn repeated in
    full is said twice. Rows with a null conversation form one conversation. A table without rows gives none.
    """
    empty = F.lit("")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get("ts", i - 1)["role"], F.get("ts", i + 1)["role"]
        opening = F.when(before == x["role"], F.lit(PART)).otherwise(F.concat(F.lit(TURN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("&#10;")), F.lit("\n")))
        return F.struct(
            opening.alias("opening"), escape(x["text"]).alias("body"), F.when(after == x["role"], empty).otherwise(F.lit(END)).alias("closing"), x["role"].isin(*loss_roles).alias("loss")
        )

    pieces = chats.select("conv_id", F.transform("ts", piece).alias("ps"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("spans"))

    def mark(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["opening"])
        end = begin + F.length(p["body"])
        more = F.concat(acc["spans"], F.array(F.struct(begin.alias("at"), F.length(p["body"]).alias("n"))))
        return F.struct((end + F.length(p["closing"])).alias("at"), F.when(p["loss"], more).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("ps", lambda p: F.concat(p["opening"], p["body"], p["closing"])), "")
    return pieces.select("conv_id", text.alias("formatted"), F.aggregate("ps", start, mark)["spans"].alias("loss_spans"))


def read_chats(chats: DataFrame) -> DataFrame:
    """``chats`` (conv_id, formatted, loss_spans) with ``turns`` (array of (role, text)) and ``loss_text``, both
    read from the formatted string and unescaped."""
    blocks = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size(F.split("formatted", r"<\|turn\|>", -1)))

    def parts(block: Column) -> Column:
        role = unescape(F.substring_index(block, "\n", 1))
        said = F.substring(block, F.instr(block, "\n") + 1, F.length(block))
        said = F.substring(said, F.lit(1), F.length(said) - len(END))
        return F.transform(F.split(said, r"<\|part\|>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["at"] + 1, s["n"]))), "")
    return chats.select("*", F.flatten(F.transform(blocks, parts)).alias("turns"), loss.alias("loss_text"))
