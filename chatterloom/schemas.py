"""Declared schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampNTZType()

BLOCK = T.StructType(
    [T.StructField("type", S), T.StructField("text", S), T.StructField("image_url", S)]
)
TOOL_CALL = T.StructType(
    [T.StructField("id", S), T.StructField("name", S), T.StructField("args", T.MapType(S, S))]
)
NOTE_VALUE = T.StructType(
    [T.StructField("text", S), T.StructField("created_at", S), T.StructField("source_thread_id", S)]
)


def _table(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


TABLES: dict[str, T.StructType] = {
    "user_account": _table(("username", S), ("created_at", TS)),
    "profile": _table(
        ("profile_id", S), ("name", S), ("created_at", TS), ("updated_at", TS), ("username", S)
    ),
    "session": _table(
        ("thread_id", S), ("title", S), ("created_at", TS), ("updated_at", TS),
        ("message_count", I), ("username", S),
    ),
    "profile_event": _table(
        ("profile_id", S), ("op", S), ("name", S), ("username", S), ("ts", TS), ("seq", L)
    ),
    "session_event": _table(
        ("thread_id", S), ("op", S), ("title", S), ("message_count", I), ("ts", TS), ("seq", L)
    ),
    "message_event": _table(
        ("thread_id", S), ("seq", L), ("op", S), ("message_id", S), ("type", S), ("content", S),
        ("blocks", T.ArrayType(BLOCK)), ("tool_calls", T.ArrayType(TOOL_CALL)), ("ts", TS),
    ),
    "message": _table(
        ("thread_id", S), ("position", L), ("message_id", S), ("type", S), ("content", S),
        ("blocks", T.ArrayType(BLOCK)), ("tool_calls", T.ArrayType(TOOL_CALL)), ("ts", TS),
    ),
    "summary_context": _table(
        ("thread_id", S), ("summary", S), ("summarized_count", I), ("updated_at", TS)
    ),
    "note_event": _table(
        ("profile_id", S), ("note_id", S), ("op", S), ("text", S), ("created_at", S),
        ("source_thread_id", S), ("seq", L),
    ),
    "note": _table(
        ("profile_id", S), ("note_id", S), ("text", S), ("created_at", S), ("source_thread_id", S)
    ),
    "checkpoint": _table(
        ("thread_id", S), ("checkpoint_id", S), ("parent_checkpoint_id", S), ("ts", TS)
    ),
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "user_account": ["username"],
    "profile": ["profile_id"],
    "session": ["thread_id"],
    "message": ["thread_id", "position"],
    "summary_context": ["thread_id"],
    "note": ["profile_id", "note_id"],
    "checkpoint": ["thread_id", "checkpoint_id"],
}

NOT_NULL: dict[str, list[str]] = {
    "profile": ["name", "created_at", "updated_at", "username"],
    "session": ["title", "created_at", "updated_at", "message_count", "username"],
    "summary_context": ["summary", "summarized_count", "updated_at"],
}

# Columns that got a default when they were added to existing tables.
COLUMN_DEFAULTS: dict[str, dict[str, object]] = {
    "session": {"title": "New Chat", "message_count": 0, "username": "default_user"},
    "profile": {"name": "Default", "username": "default_user"},
    "summary_context": {"summary": "", "summarized_count": 0},
}
