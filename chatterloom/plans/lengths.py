"""Kept sums of message lengths, so that a compaction check reads no text of old messages.

``thread_id, block, messages, chars``: how many messages and characters lie at positions
``[block * width, (block + 1) * width)`` of a thread. The sums are additive: a day's new messages are added
(``advance``) without looking at the days before, edits are added as differences (``edited``), and where
messages go, positions after them move, so a thread is summed again from the first such block (``refresh``).
``candidates_from_blocks`` then takes whole blocks from the sums and reads messages only at the two ends of a span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.config import CompactionConfig
from chatterloom.functions import text as X
from chatterloom.operators.blocks import rows_in_spans

WIDTH = 4096


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("thread_id", "block").agg(F.sum("messages").alias("messages"), F.sum("chars").alias("chars"))


def length_blocks(messages: DataFrame, width: int = WIDTH) -> DataFrame:
    """Block sums of ``messages(thread_id, position, content)``; a null content counts as a message of length 0."""
    return _summed(
        messages.select(
            "thread_id", F.expr(f"position div {width}").alias("block"), F.lit(1).cast("bigint").alias("messages"),
            X.content_length(F.col("content")).cast("bigint").alias("chars"),
        )
    )


def advance(blocks: DataFrame, appended: DataFrame, width: int = WIDTH) -> DataFrame:
    """Add new messages; only they are read."""
    return _summed(blocks.unionByName(length_blocks(appended, width)))


def edited(blocks: DataFrame, edits: DataFrame, width: int = WIDTH) -> DataFrame:
    """Texts written over in place: ``edits(thread_id, position, before, after)``, one row a message."""
    change = X.content_length(F.col("after")) - X.content_length(F.col("before"))
    differences = edits.select(
        "thread_id", F.expr(f"position div {width}").alias("block"), F.lit(0).cast("bigint").alias("messages"),
        change.cast("bigint").alias("chars"),
    )
    return _summed(blocks.unionByName(differences))


def refresh(blocks: DataFrame, messages: DataFrame, changed: DataFrame, width: int = WIDTH) -> DataFrame:
    """Sums after removals: ``changed(thread_id, position)`` is the first position that is not as it was.

    ``messages`` are the current ones. Threads that are not named keep their sums; several rows of a thread count
    by their smallest position.
    """
    first = changed.groupBy("thread_id").agg(F.min(F.expr(f"position div {width}")).alias("_from"))
    kept = blocks.join(first, "thread_id", "left").filter("_from IS NULL OR block < _from").drop("_from")
    anew = messages.select("thread_id", "position", "content").join(first, "thread_id").filter(
        F.col("position") >= F.col("_from") * width
    )
    return kept.unionByName(length_blocks(anew, width))


def candidates_from_blocks(
    blocks: DataFrame, messages: DataFrame, summaries: DataFrame, cfg: CompactionConfig = CompactionConfig(), width: int = WIDTH
) -> DataFrame:
    """``compaction_candidates`` out of kept sums: the same rows.

    Messages are joined on (thread, block) and only for the parts of blocks at the ends of a span, at most ``2 * width``
    for a due thread; whole blocks in between come from the sums.
    """
    counts = blocks.groupBy("thread_id").agg(F.sum("messages").alias("hi"))
    zero = F.lit(0).cast("bigint")
    spans = counts.join(summaries.select("thread_id", "summarized_count"), "thread_id", "left").select(
        "thread_id", F.coalesce("summarized_count", zero).cast("bigint").alias("lo"), "hi"
    )
    due = spans.withColumn("tail", F.col("hi") - F.col("lo")).filter(F.col("tail") > cfg.keep_last).select(
        "thread_id", "lo", (F.col("hi") - cfg.keep_last).alias("hi"), "tail"
    )
    # Whole blocks are [first, last); a span inside one block has none.
    placed = due.withColumns({"_first": F.expr(f"(lo + {width - 1}) div {width}"), "_last": F.expr(f"hi div {width}")})
    whole = placed.join(blocks, "thread_id").filter("block >= _first AND block < _last").select("thread_id", "chars")
    ends = placed.select(
        "thread_id",
        F.inline(
            F.when(
                F.col("_first") < F.col("_last"),
                F.array(
                    F.struct(F.col("lo"), (F.col("_first") * width).alias("hi")),
                    F.struct((F.col("_last") * width).alias("lo"), F.col("hi")),
                ),
            ).otherwise(F.array(F.struct("lo", "hi")))
        ),
    )
    sized = messages.select("thread_id", "position", X.content_length(F.col("content")).cast("bigint").alias("chars"))
    parts = rows_in_spans(sized, ends, width=width).select("thread_id", "chars")
    sums = whole.unionByName(parts).groupBy("thread_id").agg(F.sum("chars").alias("chars"))
    folded = due.join(sums, "thread_id", "left").withColumn(
        "tokens", X.tokens_from_chars(F.coalesce("chars", zero), cfg.chars_per_token)
    )
    return folded.filter((F.col("tokens") > cfg.max_tokens) | (F.col("tail") > cfg.max_messages)).select(
        "thread_id", F.col("lo").alias("start"), F.col("tail").alias("tail_messages"),
        (F.col("hi") - F.col("lo")).alias("foldable_messages"), "tokens",
    )
