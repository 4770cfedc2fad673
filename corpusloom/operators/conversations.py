"""Thread logs: history, tail and question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import render as R
from corpusloom.functions import text as T
from corpusloom.operators.numbering import first_per_group, with_next

# Fixed value: messages shown by the history command.
HISTORY_LENGTH = 10


def history(messages: DataFrame, conv_id) -> DataFrame:
    """All messages of one thread, oldest first."""
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def tail(messages: DataFrame, n: int = HISTORY_LENGTH) -> DataFrame:
    """The last ``n`` messages of every thread with their display line.

    ``position`` counts from the oldest one shown.
    """
    last = first_per_group(messages, ["conv_id"], [F.col("turn").desc()], n, "_back")
    shown = F.count("*").over(_thread())
    line = F.concat(
        R.role_label("role"), F.lit(": "), F.substring("text", 1, T.HIT_PREVIEW_LENGTH), F.lit(T.ELLIPSIS)
    )
    return last.select(
        "conv_id",
        "turn",
        (shown - F.col("_back") + 1).cast("int").alias("position"),
        "role",
        line.alias("line"),
    )


def _thread():
    from pyspark.sql import Window

    return Window.partitionBy("conv_id")


def pairs(messages: DataFrame, block: int = 4096) -> DataFrame:
    """Each user message with the assistant message right after it.

    Blank user messages are dropped first; an unanswered one has no pair.
    """
    kept = messages.filter((F.col("role") != "user") | ~T.is_blank("text"))
    following = with_next(kept, "conv_id", "turn", ["role", "text"], block)
    return following.filter((F.col("role") == "user") & (F.col("next.role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("message"), F.col("next.text").alias("response")
    )
