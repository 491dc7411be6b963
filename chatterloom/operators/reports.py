"""Scoped counts, joins, top-k and per-thread reports."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.functions import text as X
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, running
from chatterloom.operators.scope import scope_to_user


def checkpoints_per_thread(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("thread_id").agg(F.count(F.lit(1)).alias("checkpoint_count"))


def scoped_checkpoint_count(
    checkpoints: DataFrame, sessions: DataFrame, user: str | None = None
) -> DataFrame:
    """Checkpoints that belong to a session; orphans never count.

    Checkpoints are counted per thread before the join, so the join sees one row
    per thread however many checkpoints a thread has.
    """
    owned = scope_to_user(sessions, user).select("thread_id")
    return (
        checkpoints_per_thread(checkpoints)
        .join(owned, "thread_id")
        .agg(F.coalesce(F.sum("checkpoint_count"), F.lit(0)).alias("checkpoints"))
    )


def checkpoint_distribution(
    checkpoints: DataFrame, sessions: DataFrame, user: str | None = None
) -> DataFrame:
    """Checkpoint count per thread with title and owner; a title falls back to the id."""
    counts = checkpoints_per_thread(checkpoints)
    named = scope_to_user(sessions, user).select("thread_id", "title", "username")
    joined = counts.join(named, "thread_id", "left" if user is None else "inner")
    return joined.select(
        "thread_id", F.coalesce("title", "thread_id").alias("title"), "username", "checkpoint_count"
    )


def top_threads(
    checkpoints: DataFrame, sessions: DataFrame, user: str | None = None, k: int = C.TOP_THREADS
) -> DataFrame:
    return (
        checkpoint_distribution(checkpoints, sessions, user)
        .orderBy(F.desc("checkpoint_count"), "thread_id")
        .limit(k)
    )


def session_index(sessions: DataFrame, summaries: DataFrame) -> DataFrame:
    """Session list with a flag for threads that have a summary."""
    known = summaries.select("thread_id", "summary")
    return sessions.join(known, "thread_id", "left").select(
        *sessions.columns, (F.coalesce("summary", F.lit("")) != "").alias("has_summary")
    )


def profile_note_counts(profiles: DataFrame, notes: DataFrame) -> DataFrame:
    counts = notes.groupBy("profile_id").agg(F.count(F.lit(1)).alias("note_count"))
    return profiles.join(counts, "profile_id", "left").select(
        "profile_id", "name", F.coalesce("note_count", F.lit(0)).alias("note_count"), "updated_at"
    )


def note_metrics(profiles: DataFrame, notes: DataFrame) -> DataFrame:
    """Profiles, notes, and notes per profile to one decimal, halves to even."""
    counts = profile_note_counts(profiles, notes)
    return counts.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.coalesce(F.sum("note_count"), F.lit(0)).alias("notes"),
        F.coalesce(F.bround(F.avg("note_count"), 1), F.lit(0.0)).alias("mean_notes"),
    )


def overview_counts(
    accounts: DataFrame,
    sessions: DataFrame,
    checkpoints: DataFrame,
    profiles: DataFrame,
    user: str | None = None,
) -> DataFrame:
    """One row: users (never scoped), chats, checkpoints, profiles."""

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")

    parts = [
        named(accounts, "users"),
        named(scope_to_user(sessions, user), "chats"),
        scoped_checkpoint_count(checkpoints, sessions, user).select(
            F.lit("checkpoints").alias("what"), F.col("checkpoints").alias("n")
        ),
        named(scope_to_user(profiles, user), "profiles"),
    ]
    counts = reduce(DataFrame.unionByName, parts)
    return counts.agg(
        *[
            F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name)
            for name in ("users", "chats", "checkpoints", "profiles")
        ]
    )


def thread_overview(
    messages: DataFrame, summaries: DataFrame, checkpoints: DataFrame, clamp: bool = False
) -> DataFrame:
    """Stored, active and summarized messages and chain length per thread.

    An edit before the boundary can leave the boundary past the end; the raw
    numbers then show a negative window and ``boundary_overrun`` says so.
    """
    stored = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("stored"))
    marks = summaries.select("thread_id", F.col("summarized_count").cast("bigint").alias("_done"))
    chain = checkpoints_per_thread(checkpoints)
    joined = stored.join(marks, "thread_id", "left").join(chain, "thread_id", "left")
    done = F.coalesce("_done", F.lit(0).cast("bigint"))
    window = F.col("stored") - done
    return joined.select(
        "thread_id",
        "stored",
        (F.greatest(window, F.lit(0)) if clamp else window).alias("active_window"),
        done.alias("summarized"),
        F.coalesce("checkpoint_count", F.lit(0)).alias("chain_length"),
        (done > F.col("stored")).alias("boundary_overrun"),
    )


def thread_tags(messages: DataFrame, summaries: DataFrame) -> DataFrame:
    noted = X.has_image_note(X.message_text(F.col("content"), F.col("blocks")))
    images = messages.groupBy("thread_id").agg(F.max(noted).alias("has_images"))
    known = summaries.filter(F.col("summary") != "").select("thread_id", F.lit(True).alias("_sum"))
    return images.join(known, "thread_id", "left").select(
        "thread_id", F.coalesce("_sum", F.lit(False)).alias("has_summary"), "has_images"
    )


def checkpoint_chain(checkpoints: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT) -> DataFrame:
    """Step number of each checkpoint and whether its parent is the previous id."""
    scanned = running(
        checkpoints.select("thread_id", "checkpoint_id", "parent_checkpoint_id"),
        ["thread_id"],
        ["checkpoint_id"],
        {"step": F.lit(1)},
        previous={"previous_id": F.col("checkpoint_id")},
        policy=policy,
    )
    return scanned.select(
        "thread_id",
        "checkpoint_id",
        "parent_checkpoint_id",
        (F.col("step") - 1).alias("step"),
        F.col("parent_checkpoint_id").eqNullSafe(F.col("previous_id")).alias("parent_ok"),
    )


def active_session(sessions: DataFrame) -> DataFrame:
    """Most recently updated session per user; run it again after deletes."""
    w = Window.partitionBy("username").orderBy(F.desc("updated_at"), "thread_id")
    return sessions.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def table_report(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Bytes, rows and share of the total per stored table.

    Bytes come from a listing of the data files, empty ones included, which opens
    none of them; rows from the counts in their footers, with no column read.
    """
    parts = []
    for name, path in paths.items():
        label = F.lit(name).alias("table_name")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        sizes = files.select("length").agg(F.sum("length").alias("bytes"))
        counts = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
        none = F.lit(None).cast("bigint")
        parts += [sizes.select(label, "bytes", none.alias("rows")), counts.select(label, none.alias("bytes"), "rows")]
    report = reduce(DataFrame.unionByName, parts).groupBy("table_name").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("bytes", "rows")]
    )
    # One row per table, so a window over all of them is small.
    total = F.sum("bytes").over(Window.partitionBy())
    share = F.when(total > 0, F.col("bytes") / total).otherwise(0.0)
    return report.withColumn("share", F.round(share, 6))


def storage_by_size(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("bytes"), "table_name")
