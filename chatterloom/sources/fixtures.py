"""Conversation-memory tables derived from the shared test tables.

Rules are in FIXTURES.md. Note and extraction texts are whole document texts.
Tables that need an ordered scan are written once before they are used.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.functions import text as X
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, running
from chatterloom.session import written

_EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"

CALLS_PATTERN = """
  filter(array(
    struct(concat(message_id, '-c0') AS id, 'add_memory' AS name,
           map('note', concat('note from ', message_id)) AS args),
    struct(concat(message_id, '-c1') AS id, 'forget_memory' AS name,
           map('note_id', lpad(string(conv_id), 12, '0')) AS args),
    struct(concat(message_id, '-c2') AS id, 'search_web' AS name,
           map('query', message_id) AS args)), (c, i) -> i <= conv_id % 3)
"""


def conversation_rows(conversations: DataFrame) -> DataFrame:
    """Messages with image notes, block content and tool calls mixed in."""
    human, ai = F.col("role") == "user", F.col("role") == "assistant"
    turn = F.col("turn")
    noted, blocky, calling = human & (turn % 5 == 3), human & (turn % 5 == 4), ai & (turn % 4 == 3)
    described = F.when(noted, F.concat(F.lit("img-"), F.col("conv_id").cast("string")))
    rows = conversations.withColumn(
        "message_id", F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    )
    return rows.select(
        "conv_id",
        "turn",
        "message_id",
        F.when(human, "human").when(ai, "ai").otherwise("system").alias("type"),
        F.when(calling, "")
        .when(blocky, F.lit(None).cast("string"))
        .otherwise(X.with_image_note(F.col("text"), described))
        .alias("content"),
        F.when(
            blocky,
            F.expr(
                """filter(array(
                     struct('text' AS type, text AS text, string(null) AS image_url),
                     struct('image_url' AS type, string(null) AS text, 'img' AS image_url)),
                     (b, i) -> i = 1 OR conv_id % 2 = 0)"""
            ),
        ).alias("blocks"),
        F.when(calling, F.expr(CALLS_PATTERN)).alias("tool_calls"),
        F.expr(f"{_EPOCH} + INTERVAL '1' HOUR * conv_id + INTERVAL '1' MINUTE * turn").alias("ts"),
    )


def _thread_number(thread_id: str = "thread_id") -> Column:
    return F.col(thread_id).cast("bigint")


class Tables:
    """Derived tables over one directory of parquet files."""

    def __init__(self, spark: SparkSession, directory: str, policy: SplitPolicy = DEFAULT_SPLIT):
        self.spark, self.directory, self.policy = spark, directory, policy

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # --- messages -------------------------------------------------------
    @cached_property
    def message(self) -> DataFrame:
        """One thread per conversation."""
        rows = conversation_rows(self.raw("conversations"))
        return rows.select(
            F.col("conv_id").cast("string").alias("thread_id"),
            F.col("turn").alias("position"),
            "message_id", "type", "content", "blocks", "tool_calls", "ts",
        )

    @cached_property
    def long_message(self) -> DataFrame:
        """Ten threads over all conversations, in (conv_id, turn) order."""
        rows = conversation_rows(self.raw("conversations")).withColumn(
            "thread_id", (F.col("conv_id") % 10).cast("string")
        )
        ranked = running(
            rows, ["thread_id"], ["conv_id", "turn"], {"position": F.lit(1)}, policy=self.policy
        )
        return written(
            ranked.select(
                "thread_id", (F.col("position") - 1).alias("position"),
                "message_id", "type", "content", "blocks", "tool_calls", "ts",
            ),
            "long-message",
        )

    @cached_property
    def message_event(self) -> DataFrame:
        """Append per message; some are removed later and half of those come back."""
        m = self.message
        base = m.withColumn("seq", F.col("position") * 10).withColumn("op", F.lit("append"))
        steps = F.when(
            F.col("position") % 7 == 5,
            F.when(
                F.col("thread_id").cast("bigint") % 2 == 0,
                F.array(F.lit(0), F.lit(5), F.lit(7)),
            ).otherwise(F.array(F.lit(0), F.lit(5))),
        ).otherwise(F.array(F.lit(0)))
        log = base.withColumn("step", F.explode(steps))
        gone = F.col("step") == 5
        return log.select(
            "thread_id",
            (F.col("seq") + F.col("step")).alias("seq"),
            F.when(gone, "remove").otherwise("append").alias("op"),
            "message_id",
            *[F.when(~gone, F.col(c)).alias(c) for c in ("type", "content", "blocks", "tool_calls")],
            F.expr("ts + INTERVAL '1' SECOND * step").alias("ts"),
        )

    # --- sessions, summaries ----------------------------------------------
    @cached_property
    def session(self) -> DataFrame:
        return self._sessions(self.message)

    @cached_property
    def long_session(self) -> DataFrame:
        return self._sessions(self.long_message)

    def _sessions(self, messages: DataFrame) -> DataFrame:
        from chatterloom.operators.messages import auto_title

        sizes = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("message_count"))
        number = _thread_number()
        created = F.expr(f"{_EPOCH} + INTERVAL '1' HOUR * bigint(thread_id)")
        return (
            sizes.join(auto_title(messages), "thread_id")
            .withColumn("created_at", created)
            .select(
                "thread_id",
                "title",
                "created_at",
                F.expr("created_at + INTERVAL '1' MINUTE * message_count").alias("updated_at"),
                F.col("message_count").cast("int").alias("message_count"),
                F.concat(F.lit("user_"), (number % 7).cast("string")).alias("username"),
            )
        )

    @cached_property
    def summary(self) -> DataFrame:
        return self._summaries(self.message)

    @cached_property
    def long_summary(self) -> DataFrame:
        return self._summaries(self.long_message)

    def _summaries(self, messages: DataFrame) -> DataFrame:
        number = _thread_number()
        sizes = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
        folded = number % 3 == 0
        return sizes.filter(folded | ((number % 3 == 1) & (number > 0))).select(
            "thread_id",
            F.when(folded, F.concat(F.lit("summary "), "thread_id")).otherwise("").alias("summary"),
            F.when(folded, F.expr("int(n div 2)")).otherwise(0).alias("summarized_count"),
            F.expr(
                f"{_EPOCH} + INTERVAL '1' HOUR * bigint(thread_id) + INTERVAL '1' MINUTE * n"
            ).alias("updated_at"),
        )

    # --- events: checkpoints, their sessions, entity log ------------------
    @cached_property
    def checkpoint(self) -> DataFrame:
        rows = self.raw("events").select(
            F.col("user_id").cast("string").alias("thread_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("checkpoint_id"),
            "ts",
        )
        linked = running(
            rows, ["thread_id"], ["checkpoint_id"],
            previous={"parent_checkpoint_id": F.col("checkpoint_id")}, policy=self.policy,
        )
        return written(linked, "checkpoint")

    @cached_property
    def checkpoint_key(self) -> DataFrame:
        """Checkpoints without the parent link, for jobs that only count them."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("thread_id"),
            F.lpad(F.col("event_id").cast("string"), 12, "0").alias("checkpoint_id"),
        )

    @cached_property
    def user_session(self) -> DataFrame:
        """Sessions of the checkpoint threads; every fifth thread has none."""
        return (
            self.raw("events")
            .filter(F.col("user_id") % 5 != 0)
            .groupBy("user_id")
            .agg(
                F.min("ts").alias("created_at"),
                F.max("ts").alias("updated_at"),
                F.count(F.lit(1)).cast("int").alias("message_count"),
            )
            .select(
                F.col("user_id").cast("string").alias("thread_id"),
                F.concat(F.lit("thread "), F.col("user_id").cast("string")).alias("title"),
                "created_at",
                "updated_at",
                "message_count",
                F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string")).alias("username"),
            )
        )

    @cached_property
    def session_event(self) -> DataFrame:
        kind = F.col("event_type")
        return (
            self.raw("events")
            .filter(kind != "purchase")
            .select(
                F.col("user_id").cast("string").alias("thread_id"),
                F.when(kind == "signup", "create")
                .when(kind == "click", "rename")
                .when(kind == "view", "touch")
                .otherwise("delete")
                .alias("op"),
                F.when(
                    kind == "click", F.concat(F.lit("t-"), F.col("event_id").cast("string"))
                ).alias("title"),
                F.when(kind == "view", F.floor("value").cast("int")).alias("message_count"),
                "ts",
                F.col("event_id").alias("seq"),
            )
        )

    # --- accounts, profiles, notes -----------------------------------------
    @cached_property
    def user_account(self) -> DataFrame:
        return self.raw("customer").select(
            X.normalize_username(F.col("c_name")).alias("username"),
            F.expr(f"{_EPOCH} + INTERVAL '1' MINUTE * c_custkey").alias("created_at"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        sources = self.raw("documents").select("source").distinct()
        number = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
        owned = sources.select(
            F.col("source").alias("profile_id"),
            F.concat(F.lit("Profile "), F.col("source")).alias("name"),
            number.alias("number"),
        )
        users = owned.select((F.col("number") % 7).alias("number")).distinct()
        empty = users.select(
            F.concat(F.lit("empty"), F.col("number").cast("string")).alias("profile_id"),
            F.lit("Empty").alias("name"),
            "number",
        )
        return owned.unionByName(empty).select(
            "profile_id",
            "name",
            F.expr(f"{_EPOCH} + INTERVAL '1' HOUR * number").alias("created_at"),
            F.expr(
                f"{_EPOCH} + INTERVAL '1' HOUR * number + INTERVAL '1' DAY * (number % 5)"
            ).alias("updated_at"),
            F.concat(F.lit("user_"), (F.col("number") % 7).cast("string")).alias("username"),
        )

    @cached_property
    def note(self) -> DataFrame:
        return self.raw("documents").select(
            F.col("source").alias("profile_id"),
            F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("note_id"),
            "text",
            X.iso_utc(F.expr(f"{_EPOCH} + INTERVAL '1' MINUTE * doc_id")).alias("created_at"),
            (F.col("doc_id") % 10).cast("string").alias("source_thread_id"),
        )

    @cached_property
    def note_delete(self) -> DataFrame:
        toxic = self.raw("labels").filter(F.col("toxic") == 1).select("doc_id")
        return self.note.join(
            toxic.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("note_id")),
            "note_id", "left_semi",
        ).select("profile_id", "note_id")

    @cached_property
    def live_note(self) -> DataFrame:
        toxic = self.raw("labels").filter(F.col("toxic") == 1)
        return self.note.join(
            toxic.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("note_id")),
            "note_id", "left_anti",
        ).select(self.note.columns)

    @cached_property
    def profile_request(self) -> DataFrame:
        """Deletion requests: each toxic document asks to drop its source's profile."""
        toxic = self.raw("labels").filter(F.col("toxic") == 1).select("doc_id")
        docs = self.raw("documents").select("doc_id", "source")
        number = F.regexp_extract("source", r"(\d+)$", 1).cast("bigint")
        # Every tenth request comes from a user who does not own the profile.
        user = F.when(F.col("doc_id") % 10 == 0, (number + 1) % 7).otherwise(number % 7)
        return docs.join(toxic, "doc_id").select(
            F.col("source").alias("profile_id"),
            F.concat(F.lit("user_"), user.cast("string")).alias("username"),
            F.expr(f"{_EPOCH} + INTERVAL '1' MINUTE * doc_id").alias("ts"),
        )

    @cached_property
    def thread_profile(self) -> DataFrame:
        """Active profile of each conversation thread."""
        return self.message.select("thread_id").distinct().select(
            "thread_id",
            F.concat(F.lit("src"), (_thread_number() % 20).cast("string")).alias("profile_id"),
        )

    @cached_property
    def image_description(self) -> DataFrame:
        """Descriptions for the block messages that carry an image."""
        return self.message.filter(F.col("blocks").isNotNull()).select(
            "message_id", F.concat(F.lit("seen "), F.col("message_id")).alias("description")
        )

    @cached_property
    def extraction(self) -> DataFrame:
        doc = F.col("doc_id")
        bullets = F.concat(F.lit("- "), F.replace(F.col("text"), F.lit(". "), F.lit(".\n- ")))
        return self.raw("documents").select(
            F.lpad(doc.cast("string"), 12, "0").alias("response_id"),
            (doc % 10).cast("string").alias("thread_id"),
            F.col("source").alias("profile_id"),
            F.when(doc % 13 == 0, "  ").when(doc % 11 == 0, " NONE ").otherwise(bullets).alias("text"),
        )
