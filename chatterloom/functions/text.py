"""Scalar functions over message, note and account columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatterloom import config as C

# The characters that count as white space at the ends of a string.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def message_text(content: Column, blocks: Column) -> Column:
    """String content as it is, else the text blocks, else the image marker."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    joined = F.when(F.size(texts) > 0, F.array_join(texts, "\n")).otherwise(F.lit(C.IMAGE_ONLY_TEXT))
    return F.coalesce(content, joined)


def has_image_note(text: Column) -> Column:
    return F.contains(text, F.lit(C.IMAGE_NOTE_MARK))


def with_image_note(text: Column, description: Column) -> Column:
    noted = F.concat(text, F.lit(C.IMAGE_NOTE_LEAD), description, F.lit(C.IMAGE_NOTE_TAIL))
    return F.when(description.isNull(), text).otherwise(noted)


def without_image_note(text: Column) -> Column:
    """The typed text that stands before an image note."""
    return F.split_part(text, F.lit(C.IMAGE_NOTE_LEAD), F.lit(1))


def display_role(kind: Column) -> Column:
    return F.when(kind == "human", "user").otherwise("assistant")


def transcript_role(kind: Column) -> Column:
    return F.upper(kind)


def normalize_username(c: Column) -> Column:
    """Trimmed lower case; a blank name becomes null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def salted_digest(secret: Column, username: Column) -> Column:
    """SHA-256 of ``secret:username``; null when either part is missing."""
    return F.sha2(F.concat(secret, F.lit(":"), normalize_username(username)), 256)


def title_from_text(text: Column) -> Column:
    short = F.substring(strip(text), 1, C.AUTO_TITLE_LENGTH)
    return F.coalesce(F.nullif(short, F.lit("")), F.lit(C.NEW_CHAT_TITLE))


def cleaned_title(title: Column) -> Column:
    """A rename to blank text is stored as the blank-title marker."""
    return F.coalesce(F.nullif(strip(title), F.lit("")), F.lit(C.BLANK_TITLE))


def content_length(content: Column) -> Column:
    """Characters of string content; block content counts zero."""
    return F.coalesce(F.length(content), F.lit(0)).cast("bigint")


def tokens_from_chars(chars: Column, chars_per_token: int = 4) -> Column:
    """Estimate for a whole list: the floor is taken once, on the sum."""
    return F.call_function("div", F.coalesce(chars, F.lit(0)), F.lit(chars_per_token)).cast("bigint")


def note_fields(value: Column) -> list[Column]:
    return [
        F.coalesce(value["text"], F.lit("")).alias("text"),
        F.coalesce(value["created_at"], F.lit("")).alias("created_at"),
        value["source_thread_id"].alias("source_thread_id"),
    ]


def in_namespace(namespace: Column, prefix: list[str]) -> Column:
    want = F.array(*[F.lit(p) for p in prefix])
    return F.slice(namespace, 1, len(prefix)) == want


def iso_utc(ts: Column) -> Column:
    """UTC in ISO form; a zone-less timestamp is UTC already, an instant is converted from the session zone."""
    shape = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"
    instant = F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), shape)
    return F.when(F.typeof(ts) == "timestamp", instant).otherwise(F.date_format(ts, shape))


def wall_micros(ts: Column) -> Column:
    """Microseconds of a zone-less timestamp since 1970, whatever the session zone."""
    since = ts - F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    return (since.cast("interval second").cast("decimal(20, 6)") * 1_000_000).cast("bigint")


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regex search; a missing text never matches."""
    return F.coalesce(text.rlike("(?iu)" + pattern), F.lit(False))


def call_count(tool_calls: Column) -> Column:
    return F.greatest(F.coalesce(F.size(tool_calls), F.lit(0)), F.lit(0))


def ends_turn(kind: Column, tool_calls: Column) -> Column:
    """A model message without tool calls closes the turn."""
    return (kind == "ai") & (call_count(tool_calls) == 0)
