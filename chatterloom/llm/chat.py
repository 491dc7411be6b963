r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every reply (a turn of the role ``assistant``) becomes an example of its own: all
preceding turns and the reply, of which only the reply's text is trainable. A
conversation whose last turn is not a reply gets one more row, which trains
nothing, so that no turn is lost. A turn is written as

    <|turn|>ROLE<|says|>TEXT<|end|>

Control strings inside roles and texts get a backslash after their first
character (``</s>`` becomes ``<\/s>``); one that has n backslashes there gets n + 1.
That is undone exactly, and no escaped text holds a control string.

The rows of a conversation meet in one row, since an example is one string;
examples are then made one at a time. An example's size is its context's.

Defined cases: a null role or text is empty; rows without a conversation id are
one conversation; turns with equal numbers go by role, then text; repeated rows
are turns of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = r"(\|\w+\|>|/?s>|/?SYS>>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def prefix_examples(
    turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant"
) -> DataFrame:
    """``key, position, text, trainable, loss_start, loss_end, last``, one row per example.

    The loss mask covers code points ``[loss_start, loss_end)`` of ``text``.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    talks = turns.select(F.col(key), F.col(turn).alias("turn"), plain(role).alias("role"), plain(text).alias("text"))
    talks = talks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    talks = talks.select(
        key,
        F.transform("turns", lambda t: t["role"] == target).alias("replies"),
        F.transform("turns", lambda t: escape(t["text"])).alias("said"),
        F.transform("turns", lambda t: F.concat(F.lit(TURN + ""), escape(t["role"]), F.lit(SAYS))).alias("heads"),
    )
    ends = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: F.element_at("replies", i) | (i == F.size("said")))
    one = talks.select("*", F.explode(ends).alias("position"))
    whole = F.array_join(
        F.slice(F.zip_with("heads", "said", lambda h, s: F.concat(h, s, F.lit(END))), F.lit(1), F.col("position")), ""
    )
    reply = F.element_at("replies", F.col("position"))
    length = F.char_length("text") - len(END)
    return one.select(
        key,
        "position",
        whole.alias("text"),
        reply.alias("trainable"),
        F.char_length(F.element_at("said", F.col("position"))).alias("_said"),
        (F.col("position") == F.size("said")).alias("last"),
    ).select(
        key, "position", "text", "trainable",
        F.when(F.col("trainable"), length - F.col("_said")).otherwise(0).alias("loss_start"),
        F.when(F.col("trainable"), length).otherwise(0).alias("loss_end"),
        "last",
    )


def read_turns(text: Column) -> Column:
    """The ``role, text`` pairs that an example's text holds."""
    parts = F.split(text, r"<\|turn\|>", -1)
    return F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            unescape(F.substring_index(p, SAYS, 1)).alias("role"),
            unescape(F.regexp_extract(p, r"(?s)<\|says\|>(.*)<\|end\|>$", 1)).alias("text"),
        ),
    )


def trained_text(example: DataFrame) -> Column:
    """The text under the loss mask of an example, as it was before escaping."""
    return unescape(F.substring(example["text"], example["loss_start"] + 1, example["loss_end"] - example["loss_start"]))
