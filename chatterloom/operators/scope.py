"""Scoping, search, lookups and orderings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.functions import text as X
from chatterloom.session import written


def scope_to_user(df: DataFrame, user: str | None) -> DataFrame:
    """``None`` means all users and adds no predicate."""
    return df if user is None else df.filter(F.col("username") == user)


def semi_scope(rows: DataFrame, sessions: DataFrame, user: str | None) -> DataFrame:
    """Rows of one user's threads, for tables that carry no username.

    One user's thread ids are written first, so that their known size can spare
    the rows a shuffle.
    """
    owned = scope_to_user(sessions, user).select("thread_id")
    if user is not None:
        owned = written(owned, "owned-threads")
    return rows.join(owned, "thread_id", "left_semi").select(rows.columns)


def search_titles(sessions: DataFrame, pattern: str) -> DataFrame:
    return sessions.filter(X.matches(F.col("title"), pattern)) if pattern else sessions


def search_notes(notes: DataFrame, pattern: str) -> DataFrame:
    return notes.filter(X.matches(F.col("text"), pattern)) if pattern else notes


def lookup_with_default(
    keys: DataFrame, table: DataFrame, on: str, defaults: Mapping[str, object]
) -> DataFrame:
    """Left lookup; columns of a missing row take their default."""
    found = keys.join(table.select(on, *defaults, F.lit(True).alias("_hit")), on, "left")
    filled = [
        F.when(F.col("_hit"), F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in defaults.items()
    ]
    return found.select(*keys.columns, *filled)


def titles_for(keys: DataFrame, sessions: DataFrame) -> DataFrame:
    return lookup_with_default(keys, sessions, "thread_id", {"title": C.NEW_CHAT_TITLE})


def profile_names_for(keys: DataFrame, profiles: DataFrame) -> DataFrame:
    return lookup_with_default(keys, profiles, "profile_id", {"name": C.UNKNOWN_PROFILE_NAME})


def summaries_for(keys: DataFrame, summaries: DataFrame) -> DataFrame:
    return lookup_with_default(keys, summaries, "thread_id", {"summary": "", "summarized_count": 0})


def visible_messages(messages: DataFrame) -> DataFrame:
    """Tool messages are counted elsewhere but never shown."""
    return messages.filter(F.col("type") != "tool")


def notes_in_namespace(store: DataFrame, prefix: Sequence[str]) -> DataFrame:
    return store.filter(X.in_namespace(F.col("namespace"), list(prefix)))


def drop_profile_namespace(store: DataFrame, profile_ids: DataFrame) -> DataFrame:
    """Delete by the first path element only, whatever follows it."""
    gone = profile_ids.select(F.col("profile_id").alias("_owner")).distinct()
    return store.join(gone, F.get("namespace", F.lit(0)) == F.col("_owner"), "left_anti")


def store_rows(notes: DataFrame) -> DataFrame:
    """Notes in the keyed-store layout: namespace path, key, value document."""
    return notes.select(
        F.array("profile_id", F.lit("notes")).alias("namespace"),
        F.col("note_id").alias("key"),
        F.struct("text", "created_at", "source_thread_id").alias("value"),
    )


def notes_from_store(store: DataFrame) -> DataFrame:
    """Note rows of a keyed store; missing fields take their defaults."""
    notes = store.filter(
        (F.size("namespace") == 2) & (F.get("namespace", F.lit(1)) == "notes")
    )
    return notes.select(
        F.get("namespace", F.lit(0)).alias("profile_id"),
        F.col("key").alias("note_id"),
        *X.note_fields(F.col("value")),
    )


# --- orderings: every one ends in the key, so ties are settled ------------


def latest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc("updated_at"), key)


def oldest_notes_first(notes: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = notes.orderBy("profile_id", "created_at", "note_id")
    return ordered if limit is None else ordered.limit(limit)


def smallest_first(df: DataFrame, measure: str, key: str) -> DataFrame:
    return df.orderBy(F.asc(measure), key)


def largest_first(df: DataFrame, measure: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(measure), key)


def one_profile_per_user(profiles: DataFrame) -> DataFrame:
    """Some profile of each user; the most recent one, so it is repeatable."""
    w = Window.partitionBy("username").orderBy(F.desc("updated_at"), "profile_id")
    return profiles.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def pseudonymize(df: DataFrame, secret: str) -> DataFrame:
    """Replace the username by a keyed digest, for exported logs."""
    return df.withColumn("username", X.salted_digest(F.lit(secret), F.col("username")))
