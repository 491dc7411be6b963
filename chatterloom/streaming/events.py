"""Incremental versions of the batch jobs over a message log.

Sinks are written tables: nothing streams through the driver. Each micro-batch
writes its own ``batch_id`` folder, so a batch replayed after a failure
overwrites its own output and counts once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chatterloom.config import Wording
from chatterloom.functions import text as X
from chatterloom.operators.logs import fold_notes, newest_per_key
from chatterloom.plans.memory import note_events_of, tool_call_effects


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str, shape: Callable[[DataFrame], DataFrame] | None = None,
    keyed_state: bool = False,
) -> StreamingQuery:
    """Write every micro-batch of a stream to ``path/batch_id=N`` and stop at the end.

    ``keyed_state`` runs it on the RocksDB state store, whatever the session's is.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        (shape(batch) if shape else batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    writer = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True)
    )
    if not keyed_state:
        return writer.start()
    conf.set(STATE_STORE, KEYED_STORE)
    try:  # a query takes the settings of its session when it starts
        return writer.start()
    finally:
        conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)


# --- thread counters ---------------------------------------------------------


def thread_state(events: DataFrame) -> DataFrame:
    """Message count and last activity per thread, in ``update`` mode.

    For streams of new messages only. A log with removals and overwrites goes
    through ``message_liveness``.
    """
    return events.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("message_count"), F.max("ts").alias("updated_at")
    )


def latest_thread_state(spark: SparkSession, path: str) -> DataFrame:
    """Current counters: the newest written row of each thread."""
    rows = spark.read.option("basePath", path).parquet(path)
    return newest_per_key(rows, ["thread_id"], ["batch_id"]).drop("batch_id")


def message_liveness(events: DataFrame) -> DataFrame:
    """Whether each message of a log is there after its last event, in ``update`` mode.

    The event with the greatest ``seq`` decides, so events may arrive in any order. State
    is one small row per message id, spread over (thread, id): a long thread is no hot
    key.
    """
    return (
        events.groupBy("thread_id", "message_id")
        .agg(F.max(F.struct("seq", "op")).alias("_last"), F.max("ts").alias("updated_at"))
        .select(
            "thread_id", "message_id", F.col("_last.seq").alias("seq"),
            (F.col("_last.op") != "remove").alias("live"), "updated_at",
        )
    )


def live_thread_state(spark: SparkSession, path: str) -> DataFrame:
    """Current counters from written liveness rows; a thread with nothing left counts 0."""
    rows = spark.read.option("basePath", path).parquet(path)
    latest = newest_per_key(rows, ["thread_id", "message_id"], ["batch_id"])
    return latest.groupBy("thread_id").agg(
        F.sum(F.col("live").cast("bigint")).alias("message_count"), F.max("updated_at").alias("updated_at")
    )


# --- notes, duplicates, answers ---------------------------------------------------


def note_events(
    messages: DataFrame, thread_profiles: DataFrame, wording: Wording = Wording()
) -> DataFrame:
    """Note log rows of the tool calls in a stream or a batch of messages."""
    return note_events_of(tool_call_effects(messages, thread_profiles, wording))


def current_notes(spark: SparkSession, path: str) -> DataFrame:
    """Fold of the note log written by the note stream."""
    return fold_notes(spark.read.option("basePath", path).parquet(path).drop("batch_id"))


def distinct_messages(events: DataFrame, lateness: str = "1 hour", time_column: str = "ts") -> DataFrame:
    """Drop replays of a thread's message id that arrive within ``lateness``.

    Ids older than that leave the state, and rows later than that are dropped. The time column is turned into an instant first: a watermark needs one.
    """
    timed = events.withColumn(time_column, F.col(time_column).cast("timestamp"))
    return timed.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(["thread_id", "message_id"])


def final_responses(events: DataFrame) -> DataFrame:
    """Answers as they arrive: model messages without tool calls."""
    return events.filter(X.ends_turn(F.col("type"), F.col("tool_calls"))).select(
        "thread_id", "message_id", X.message_text(F.col("content"), F.col("blocks")).alias("response")
    )
