"""What a model would be sent: notes, summary and the unsummarized tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.config import Wording
from chatterloom.functions import text as X
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, byte_pages
from chatterloom.operators.messages import unsummarized_tail

PAGE_BYTES = 8 * 1024 * 1024


def _notes_pages(
    notes: DataFrame, with_ids: bool, wording: Wording, page_bytes: int, policy: SplitPolicy
) -> DataFrame:
    """``profile_id, page, pages, text``; pages are laid out on sizes, texts join last."""
    if with_ids:
        line = F.concat(F.lit("- [id: "), "note_id", F.lit("] "), F.coalesce("text", F.lit("")))
        header = wording.notes_header
    else:
        line = F.concat(F.lit("- "), F.coalesce("text", F.lit("")))
        header = wording.notes_header_plain
    size = F.octet_length(line) + 1
    order = ["created_at", "note_id"]
    placed = byte_pages(
        notes.select("profile_id", *order, size.alias("_size")), ["profile_id"], order, F.col("_size"), page_bytes, policy
    )
    pages = (
        notes.select("profile_id", "note_id", line.alias("line"))
        .join(placed, ["profile_id", "note_id"])
        .groupBy("profile_id", "page", "pages")
        .agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("lines"))
    )
    body = F.array_join(F.col("lines.line"), "\n")
    first = F.concat(F.lit(header + "\n"), body)
    return pages.select("profile_id", "page", "pages", F.when(F.col("page") == 0, first).otherwise(body).alias("text"))


def notes_context(
    notes: DataFrame,
    with_ids: bool = True,
    wording: Wording = Wording(),
    page_bytes: int = PAGE_BYTES,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """Notes of each profile as text lines, oldest first, under a header.

    One row per profile, and further rows where the text passes ``page_bytes``; the
    pages joined with newlines are the whole text. Profiles without notes have
    no row.
    """
    return _notes_pages(notes, with_ids, wording, page_bytes, policy).drop("pages")


def note_token_totals(notes: DataFrame, chars_per_token: int = 4) -> DataFrame:
    """Estimated tokens of each profile's note texts."""
    return notes.groupBy("profile_id").agg(
        X.tokens_from_chars(F.sum(F.length("text")), chars_per_token).alias("note_tokens")
    )


def _wrapped_summary(wording: Wording) -> Column:
    shown = F.nullif(F.col("summary"), F.lit(""))
    return F.concat(F.lit(wording.summary_lead), shown, F.lit(wording.summary_tail))


def assemble_context(
    messages: DataFrame,
    summaries: DataFrame,
    notes: DataFrame,
    active: DataFrame,
    wording: Wording = Wording(),
    page_bytes: int = PAGE_BYTES,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """Model input of all active threads, with each profile's notes stated once.

    ``active(thread_id, profile_id)``. Rows are of three kinds, told apart by
    ``position``: -2 for the notes of a profile that has an active thread (no
    ``thread_id``; pages follow each other in ``part``), -1 for every active thread
    with its profile and its summary (null without one), and the unsummarized
    messages at their own positions (no ``profile_id``). So the output grows with notes plus
    threads, not with their product; ``assemble_context_requested`` joins the text.
    """
    threads = active.select("thread_id", "profile_id")
    owned = notes.join(threads.select("profile_id"), "profile_id", "left_semi")
    no_blocks = F.lit(None).cast(messages.schema["blocks"].dataType)
    first = F.lit(0).cast("bigint")
    noted = _notes_pages(owned, True, wording, page_bytes, policy).select(
        "profile_id", F.lit(None).cast("string").alias("thread_id"), F.lit(-2).cast("bigint").alias("position"),
        F.col("page").alias("part"), F.lit("system").alias("type"), F.col("text").alias("content"), no_blocks.alias("blocks"),
    )
    headed = threads.join(summaries.select("thread_id", "summary"), "thread_id", "left").select(
        "profile_id", "thread_id", F.lit(-1).cast("bigint").alias("position"), first.alias("part"),
        F.lit("system").alias("type"), _wrapped_summary(wording).alias("content"), no_blocks.alias("blocks"),
    )
    tail = unsummarized_tail(messages, summaries, only=threads).select(
        F.lit(None).cast("string").alias("profile_id"), "thread_id", "position", first.alias("part"), "type", "content", "blocks"
    )
    return noted.unionByName(headed).unionByName(tail)


def assemble_context_requested(
    messages: DataFrame,
    summaries: DataFrame,
    notes: DataFrame,
    requested: DataFrame,
    wording: Wording = Wording(),
    page_bytes: int = PAGE_BYTES,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """Model input of the requested threads as text, one row per part.

    ``requested(thread_id, profile_id)``: the threads that are about to be sent; each
    of them repeats the notes of its profile. The system block is at position -1: notes
    first, then the summary, set apart by a rule; it is missing when both are
    empty. It is one row unless the notes pass ``page_bytes``: then their pages
    follow each other in ``part``, the summary on the last. Tail messages follow at
    their positions.
    """
    threads = requested.select("thread_id", "profile_id")
    owned = notes.join(threads.select("profile_id"), "profile_id", "left_semi")
    pages = _notes_pages(owned, True, wording, page_bytes, policy)
    known = summaries.select("thread_id", _wrapped_summary(wording).alias("_summary"))
    system = (
        threads.join(known, "thread_id", "left")
        .join(pages, "profile_id", "left")
        .filter("text IS NOT NULL OR _summary IS NOT NULL")
    )
    part = F.coalesce("page", F.lit(0).cast("bigint"))
    on_last = F.when(part == F.coalesce("pages", F.lit(1)) - 1, F.col("_summary"))
    block = system.select(
        "thread_id",
        F.lit(-1).cast("bigint").alias("position"),
        part.alias("part"),
        F.lit("system").alias("type"),
        F.concat_ws(wording.section_rule, "text", on_last).alias("content"),
        F.lit(None).cast(messages.schema["blocks"].dataType).alias("blocks"),
    )
    tail = unsummarized_tail(messages, summaries, only=threads)
    return block.unionByName(
        tail.select("thread_id", "position", F.lit(0).cast("bigint").alias("part"), "type", "content", "blocks")
    )
