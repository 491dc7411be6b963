"""Per-message tables: composition, running lengths, tails, turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.config import CompactionConfig, Wording
from chatterloom.functions import text as X
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, rows_in_spans, running
from chatterloom.session import written


def with_text(messages: DataFrame) -> DataFrame:
    return messages.withColumn("text", X.message_text(F.col("content"), F.col("blocks")))


def describe_images(messages: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Replace image blocks by their text description, so a log is text only.

    ``descriptions(message_id, description)``. Messages without an image block
    keep their content and are not shuffled. A described message keeps its own
    text, followed by the image note; an undescribed one shows the image marker.
    """
    has_image = F.exists("blocks", lambda b: b["type"] != "text")
    pictured = F.col("content").isNull() & F.coalesce(has_image, F.lit(False))
    no_blocks = F.lit(None).cast(messages.schema["blocks"].dataType)
    text = X.message_text(F.col("content"), F.col("blocks"))
    plain = messages.filter(~pictured).withColumn("content", text).withColumn("blocks", no_blocks)
    own = F.array_join(
        F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"
    )
    described = X.with_image_note(own, F.col("description"))
    shown = F.when(F.col("description").isNull(), text).otherwise(described)
    joined = messages.filter(pictured).join(descriptions, "message_id", "left")
    replaced = joined.withColumn("content", shown).withColumn("blocks", no_blocks)
    return plain.unionByName(replaced.select(messages.columns))


def message_count(messages: DataFrame) -> DataFrame:
    """All messages, tool messages included."""
    return messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"))


def auto_title(messages: DataFrame) -> DataFrame:
    """First user text of a thread, without image note, stripped and cut; threads without one get the default."""
    human = F.col("type") == "human"
    title = X.title_from_text(X.without_image_note(X.message_text(F.col("content"), F.col("blocks"))))
    short = messages.select(
        "thread_id", F.when(human, F.col("position")).alias("_at"), F.when(human, title).alias("_title")
    )
    return short.groupBy("thread_id").agg(
        F.coalesce(F.min_by("_title", "_at"), F.lit(C.NEW_CHAT_TITLE)).alias("title")
    )


def last_human(messages: DataFrame) -> DataFrame:
    """Last user message per thread: its position, id and text."""
    human = messages.filter(F.col("type") == "human")
    at = human.groupBy("thread_id").agg(F.max("position").alias("position"))
    return human.join(at, ["thread_id", "position"]).select(
        "thread_id", "position", "message_id", X.message_text(F.col("content"), F.col("blocks")).alias("text")
    )


def role_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("thread_id", X.display_role(F.col("type")).alias("role")).agg(
        F.count(F.lit(1)).alias("messages")
    )


def token_totals(messages: DataFrame, cfg: CompactionConfig = CompactionConfig()) -> DataFrame:
    chars = F.sum(X.content_length(F.col("content")))
    return messages.groupBy("thread_id").agg(
        X.tokens_from_chars(chars, cfg.chars_per_token).alias("tokens")
    )


def message_index(messages: DataFrame) -> DataFrame:
    """1-based index and text length; positions are dense, so no window is needed."""
    return with_text(messages).select(
        "thread_id",
        (F.col("position") + 1).alias("turn_index"),
        X.display_role(F.col("type")).alias("role"),
        F.length("text").cast("bigint").alias("length"),
    )


def cumulative_chars(messages: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT) -> DataFrame:
    sized = with_text(messages).select(
        "thread_id", "position", F.length("text").cast("bigint").alias("length")
    )
    return running(
        sized, ["thread_id"], ["position"], {"cumulative_chars": F.col("length")}, policy=policy
    )


def mark_summarized(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Flag the messages before the boundary of their thread."""
    counts = summaries.select("thread_id", "summarized_count")
    return messages.join(counts, "thread_id", "left").withColumn(
        "is_summarized", F.col("position") < F.coalesce("summarized_count", F.lit(0))
    ).drop("summarized_count")


def message_composition(
    messages: DataFrame, summaries: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Index, role, length, running length, image and summarized flags, boundary.

    Bodies are reduced to lengths and flags before the only exchange by
    (thread, block); the summaries join comes last, where adaptive execution can
    split a long thread.
    """
    rows = with_text(messages).select(
        "thread_id",
        "position",
        X.display_role(F.col("type")).alias("role"),
        F.length("text").cast("bigint").alias("length"),
        X.has_image_note(F.col("text")).alias("has_image_note"),
    )
    summed = running(
        rows, ["thread_id"], ["position"], {"cumulative_chars": F.col("length")}, policy=policy
    )
    count = F.coalesce("summarized_count", F.lit(0))
    return summed.join(
        summaries.select("thread_id", "summarized_count"), "thread_id", "left"
    ).select(
        "thread_id",
        (F.col("position") + 1).alias("turn_index"),
        "role",
        "length",
        "cumulative_chars",
        "has_image_note",
        (F.col("position") < count).alias("is_summarized"),
        F.when(count > 0, count + F.lit(0.5).cast("double")).alias("boundary"),
    )


# --- tails and cuts -----------------------------------------------------------


def thread_spans(messages: DataFrame, summaries: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """``thread_id, lo, hi``: the unsummarized part of every thread, or of ``only``."""
    counts = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("hi"))
    if only is not None:
        counts = counts.join(only.select("thread_id"), "thread_id", "left_semi")
    return counts.join(
        summaries.select("thread_id", "summarized_count"), "thread_id", "left"
    ).select(
        "thread_id", F.coalesce("summarized_count", F.lit(0)).cast("bigint").alias("lo"), "hi"
    )


def unsummarized_tail(messages: DataFrame, summaries: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Messages from the boundary on; none when the boundary is past the end.

    With ``only`` the spans are written first: for few threads their known size
    spares the message bodies a shuffle.
    """
    spans = thread_spans(messages, summaries, only)
    if only is not None:
        spans = written(spans, "tail-spans")
    return rows_in_spans(messages, spans).select(messages.columns)


def foldable_split(
    messages: DataFrame, summaries: DataFrame, cfg: CompactionConfig = CompactionConfig()
) -> DataFrame:
    """The tail with ``foldable``: everything but the last ``keep_last`` rows."""
    tail = rows_in_spans(messages, thread_spans(messages, summaries))
    return tail.withColumn(
        "foldable", F.col("position") < F.col("hi") - cfg.keep_last
    ).select(*messages.columns, "foldable")


def truncate_from(messages: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept, removed)`` around ``edits(thread_id, edit_position)``.

    Threads without an edit are kept whole. ``removed`` is every message from
    the edited one on.
    """
    cut = edits.select("thread_id", "edit_position")
    marked = messages.join(cut, "thread_id", "left")
    stays = F.coalesce(F.col("position") < F.col("edit_position"), F.lit(True))
    kept = marked.filter(stays).select(messages.columns)
    ends = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("hi"))
    spans = ends.join(cut, "thread_id").select(
        "thread_id", F.greatest("edit_position", F.lit(0)).cast("bigint").alias("lo"), "hi"
    )
    removed = rows_in_spans(messages, spans).select(*messages.columns, F.col("lo").alias("edit_position"))
    return kept, removed


# --- turns --------------------------------------------------------------------


def final_responses(
    messages: DataFrame, wording: Wording = Wording(), policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Answer of every user turn: its last model message without tool calls.

    The turn scan carries only positions and flags; answer bodies are fetched by
    (thread, position) afterwards.
    """
    human = (F.col("type") == "human").cast("int")
    answer = X.ends_turn(F.col("type"), F.col("tool_calls"))
    flags = messages.select("thread_id", "position", human.alias("_human"), answer.alias("_answer"))
    turns = (
        running(flags, ["thread_id"], ["position"], {"turn_no": F.col("_human")}, policy=policy)
        .filter("turn_no > 0")
        .groupBy("thread_id", "turn_no")
        .agg(F.max(F.when(F.col("_answer"), F.col("position"))).alias("position"))
    )
    answers = messages.filter(answer).select(
        "thread_id", "position", X.message_text(F.col("content"), F.col("blocks")).alias("_text")
    )
    text = F.col("_text")
    shown = F.when(X.strip(text) != "", text).otherwise(F.lit(wording.no_answer))
    return turns.join(answers, ["thread_id", "position"], "left").select(
        "thread_id", "turn_no", shown.alias("response")
    )
