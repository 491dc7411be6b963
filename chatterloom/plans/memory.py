"""Memory notes out of tool calls and bullet text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.config import Wording
from chatterloom.functions import text as X
from chatterloom.functions.model import TextFunction, apply_text_function
from chatterloom.operators.messages import last_human
from chatterloom.session import written


def tool_call_effects(
    messages: DataFrame, thread_profiles: DataFrame, wording: Wording = Wording(), note_id: Column | None = None
) -> DataFrame:
    """One row per tool call: what it does and the tool message it answers with.

    ``note_id`` names new notes. It defaults to a digest of the call id, so a
    rerun after a lost executor yields the same ids. ``seq`` is the calling message's
    number in its log; a table without that column is numbered by position.
    """
    seq = F.col("seq" if "seq" in messages.columns else "position")
    calls = messages.filter(X.call_count(F.col("tool_calls")) > 0).select(
        "thread_id", "position", seq.alias("seq"), "message_id", "ts", F.posexplode("tool_calls").alias("call_no", "call")
    ).withColumn("call_no", F.col("call_no").cast("bigint"))
    owned = calls.join(thread_profiles.select("thread_id", "profile_id"), "thread_id", "left")
    name, args = F.col("call.name"), F.col("call.args")
    arg = F.when(name == C.ADD_NOTE_TOOL, F.try_element_at(args, F.lit("note"))).when(
        name == C.FORGET_NOTE_TOOL, F.try_element_at(args, F.lit("note_id"))
    )
    new_id = F.sha2(F.concat_ws(":", "thread_id", "call.id"), 256) if note_id is None else note_id
    action = (
        F.when((name == C.ADD_NOTE_TOOL) & arg.isNotNull(), "put")
        .when((name == C.FORGET_NOTE_TOOL) & arg.isNotNull(), "delete")
        .when(name.isin(C.ADD_NOTE_TOOL, C.FORGET_NOTE_TOOL), "failed")
        .otherwise("unknown")
    )
    acted = owned.select(
        "thread_id", "profile_id", "position", "seq", "message_id", "ts", "call_no",
        F.col("call.id").alias("tool_call_id"),
        name.alias("tool"),
        arg.alias("argument"),
        action.alias("action"),
        F.when(action == "put", new_id).when(action == "delete", arg).alias("note_id"),
    )
    answer = (
        F.when(F.col("action") == "put", F.concat(F.lit(wording.note_saved), "note_id"))
        .when(F.col("action") == "delete", F.concat(F.lit(wording.note_removed), "note_id"))
        .when(F.col("action") == "failed", F.concat(F.lit(wording.bad_arguments), "tool"))
        .otherwise(F.concat(F.lit(C.UNKNOWN_TOOL), "tool"))
    )
    return acted.withColumn("answer", answer)


def note_events_of(effects: DataFrame) -> DataFrame:
    """Note log rows, ordered within a profile by time and then by the call's place (``seq, sub``)."""
    put = F.col("action") == "put"
    return effects.filter(F.col("action").isin("put", "delete")).select(
        "profile_id",
        "note_id",
        F.col("action").alias("op"),
        F.when(put, F.col("argument")).alias("text"),
        F.when(put, X.iso_utc(F.col("ts"))).alias("created_at"),
        F.when(put, F.col("thread_id")).alias("source_thread_id"),
        X.wall_micros(F.col("ts")).alias("seq"),
        F.col("call_no").alias("sub"),
    )


def profile_touches_of(effects: DataFrame) -> DataFrame:
    """Profiles whose notes changed, with the time of the last change."""
    return (
        effects.filter(F.col("action").isin("put", "delete"))
        .groupBy("profile_id")
        .agg(F.max("ts").alias("updated_at"))
    )


def tool_messages_of(effects: DataFrame) -> DataFrame:
    """One tool message per call, carrying the call id, right after the calling message.

    It shares the caller's ``seq`` and comes after it by ``sub``, so any number of calls
    fits whatever the numbering of the log.
    """
    return effects.select(
        "thread_id",
        "seq",
        (F.col("call_no") + 1).alias("sub"),
        F.lit("append").alias("op"),
        F.concat("tool_call_id", F.lit("-result")).alias("message_id"),
        F.lit("tool").alias("type"),
        F.col("answer").alias("content"),
        "tool_call_id",
        "ts",
    )


def dispatch_tool_calls(
    messages: DataFrame, thread_profiles: DataFrame, wording: Wording = Wording()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(note_events, profile_touches, tool_messages)`` of all tool calls."""
    effects = tool_call_effects(messages, thread_profiles, wording)
    return note_events_of(effects), profile_touches_of(effects), tool_messages_of(effects)


def touch_profiles(profiles: DataFrame, touches: DataFrame) -> DataFrame:
    """Move ``updated_at`` forward for touched profiles; unknown ids do nothing."""
    late = touches.select("profile_id", F.col("updated_at").alias("_touched"))
    return profiles.join(late, "profile_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_touched")
    ).select(profiles.columns)


def extraction_prompts(
    messages: DataFrame, thread_profiles: DataFrame, wording: Wording = Wording()
) -> DataFrame:
    """What to ask about the last exchange of each thread.

    The last user text and the last finished answer; threads whose last user
    message is empty, or that have no answer, are left out.
    """
    answers = messages.filter(X.ends_turn(F.col("type"), F.col("tool_calls")))
    at = answers.groupBy("thread_id").agg(F.max("position").alias("position"))
    answered = answers.join(at, ["thread_id", "position"]).select(
        "thread_id", X.message_text(F.col("content"), F.col("blocks")).alias("_answer")
    )
    spoken = last_human(messages).filter(F.col("text") != "")
    asked = spoken.join(answered, "thread_id").join(thread_profiles.select("thread_id", "profile_id"), "thread_id")
    return asked.select(
        F.col("message_id").alias("response_id"),
        "thread_id",
        "profile_id",
        F.concat(
            F.lit(wording.extract_lead), F.col("text"), F.lit(wording.extract_join), "_answer", F.lit(wording.extract_tail)
        ).alias("prompt"),
    )


def ask_for_notes(
    prompts: DataFrame, function: TextFunction, answers: str | None = None, model: str = ""
) -> DataFrame:
    """Responses of a user function to extraction prompts, each asked once; ``answers`` as in ``apply_text_function``."""
    due = prompts.withColumnRenamed("prompt", "text").withColumn("due", F.lit(True))
    return written(apply_text_function(due, function, answers=answers, model=model).drop("due"), "responses")


def usable_responses(responses: DataFrame, spoken: DataFrame) -> DataFrame:
    """Responses that may yield notes: non-empty, not ``NONE``, and the thread's
    last user message (``spoken``, from ``last_human``) is not empty."""
    text = X.strip(F.col("text"))
    kept = responses.withColumn("_body", text).filter((text != "") & (text != "NONE"))
    heard = spoken.filter(F.col("text") != "").select("thread_id")
    return kept.join(heard, "thread_id", "left_semi")


def extract_notes(responses: DataFrame, spoken: DataFrame) -> DataFrame:
    """Bullet lines of model output as notes, numbered within their response.

    ``responses(response_id, thread_id, profile_id, text)``. A line counts when,
    stripped, it starts with ``- `` and has text after it.
    """
    heard = spoken.filter(F.col("text") != "").select("thread_id")
    # Blank and NONE responses hold no bullet, so they need no test of their own.
    # A stripped line that starts with "- " always has text after it.
    lines = F.transform(F.split(X.strip(F.col("text")), "\n"), X.strip)
    return (
        responses.join(heard, "thread_id", "left_semi")
        .select("response_id", "thread_id", "profile_id", F.posexplode(lines).alias("line_no", "line"))
        .filter(F.startswith("line", F.lit("- ")))
        .select(
            "response_id", "thread_id", "profile_id", F.col("line_no").cast("bigint").alias("line_no"),
            X.strip(F.substr("line", F.lit(3))).alias("text"),
        )
    )


def extraction_touches(responses: DataFrame, spoken: DataFrame) -> DataFrame:
    """Profiles touched by extraction, also when no line qualified."""
    return usable_responses(responses, spoken).select("profile_id").distinct()
