"""Edits of past messages and past states of a thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, rows_in_spans, running
from chatterloom.operators.logs import append_messages, fold_messages
from chatterloom.session import written


def regenerate_events(
    events: DataFrame, edits: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Log rows that replace the last user message of each edited thread.

    ``edits(thread_id, message_id, content, ts)``. Everything from the last user
    message on is removed and the edited message appended; a thread without one
    only gets the append. The log itself keeps all its rows, and those of threads
    without an edit are not folded.
    """
    events = events.join(edits.select("thread_id"), "thread_id", "left_semi")
    state = written(
        fold_messages(events, policy=policy).select("thread_id", "position", "message_id", "type"), "state"
    )
    human = F.max(F.when(F.col("type") == "human", F.col("position")))
    cut = state.groupBy("thread_id").agg(human.alias("lo"), F.count(F.lit(1)).alias("hi"))
    tops = events.groupBy("thread_id").agg(F.max("seq").alias("_top"))
    spans = cut.filter("lo IS NOT NULL").join(tops, "thread_id")
    drops = rows_in_spans(state, spans).select(
        "thread_id",
        (F.col("_top") + 1 + F.col("position") - F.col("lo")).alias("seq"),
        F.lit("remove").alias("op"),
        "message_id",
        F.lit(None).cast("string").alias("type"),
        F.lit(None).cast("string").alias("content"),
    )
    dropped = F.coalesce(F.col("hi") - F.col("lo"), F.lit(0))
    adds = edits.join(tops, "thread_id", "left").join(cut, "thread_id", "left").select(
        "thread_id",
        (F.coalesce("_top", F.lit(-1)) + 1 + dropped).alias("seq"),
        F.lit("append").alias("op"),
        "message_id",
        F.lit("human").alias("type"),
        "content",
    )
    return drops.unionByName(adds)


def regenerate(events: DataFrame, edits: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT) -> DataFrame:
    """The log with the edit events appended."""
    return append_messages(events, regenerate_events(events, edits, policy))


def message_versions(events: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT) -> DataFrame:
    """When each version of a message is the one in its thread.

    ``thread_id, message_id, seq, sub`` of the append that holds it, ``born`` (the append that
    placed the message: the first since its last removal) and ``until``, the ``seq`` of the event
    that replaces or removes it; null if it still stands. Ids and numbers only.
    """
    key, at = ["thread_id", "message_id"], F.struct("seq", "sub")
    given = F.coalesce("sub", F.lit(0)) if "sub" in events.columns else F.lit(0)
    ids = written(
        events.select(*key, "seq", given.cast("bigint").alias("sub"), (F.col("op") == "remove").cast("bigint").alias("_rm")), "event-ids"
    )
    event = F.struct("seq", "sub", "_rm")
    lives = written(
        running(ids, key, ["seq", "sub"], {"_life": F.col("_rm")}, previous={"_before": event}, policy=policy), "lives"
    )
    born = lives.filter("_rm = 0").groupBy(*key, "_life").agg(F.min(at).alias("born"))
    replaced = lives.filter("_before._rm = 0").select(
        *key, (F.col("_life") - F.col("_rm")).alias("_life"), "_before.seq", "_before.sub", F.col("seq").alias("until")
    )
    last = lives.groupBy(*key).agg(F.max(F.struct("seq", "sub", "_rm", "_life")).alias("_last")).filter("_last._rm = 0")
    standing = last.select(*key, "_last._life", "_last.seq", "_last.sub", F.lit(None).cast("bigint").alias("until"))
    return replaced.unionByName(standing).join(born, [*key, "_life"]).drop("_life")


def stabbed(
    spans: DataFrame, points: DataFrame, *, key: str = "thread_id", low: str = "lo", high: str = "hi", at: str = "at"
) -> DataFrame:
    """Pairs of a span ``[low, high)`` and a point in it, of the same key; numbers from 0.

    A span is cut into at most two dyadic tiles of each size, and a point lies in one tile of each
    size, so a pair meets in exactly one tile: an equi-join without a test behind
    it, whose input grows with the logarithm of the positions and whose rows are the result.
    """
    bits = spans.agg(F.length(F.bin(F.coalesce(F.max(high), F.lit(0))))).scalar()
    sized = spans.filter(F.col(low) < F.col(high)).withColumn("_bits", bits)
    first, past = f"shiftright({low} + shiftleft(1L, l) - 1, l)", f"shiftright({high}, l)"
    tiles = F.expr(
        f"""explode(array_compact(flatten(transform(sequence(0, _bits), l -> array(
          if({first} < {past} AND {first} % 2 = 1, struct(l, {first} AS tile), null),
          if({first} < {past} AND {past} % 2 = 1, struct(l, {past} - 1 AS tile), null))))))"""
    ).alias("_t")
    cut = sized.select("*", tiles).select(*spans.columns, F.col("_t.l").alias("_level"), F.col("_t.tile").alias("_tile"))
    levels = F.explode(F.sequence(F.lit(0), bits)).alias("_level")
    placed = points.filter(F.col(at) >= 0).select("*", levels).withColumn("_tile", F.expr(f"shiftright({at}, _level)"))
    return cut.join(placed, [key, "_level", "_tile"]).drop("_level", "_tile")


def thread_state_asof(
    events: DataFrame, requests: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Message list of a thread as it stood at ``requests(request_id, thread_id, seq)``.

    Versions of messages are intervals of ``seq``; a request picks those it lies in. Messages move as
    ids and numbers until each request's list is in order; bodies are joined last.
    """
    keys = ["request_id", "thread_id"]
    least = events.agg(F.min("seq")).scalar()
    latest = events.agg(F.max("seq")).scalar()
    spans = message_versions(events, policy).select(
        "thread_id", "message_id", "seq", "sub", "born",
        (F.col("seq") - least).alias("lo"), (F.coalesce("until", latest + 1) - least).alias("hi"),
    )
    points = requests.select(*keys, (F.least(F.col("seq"), latest) - least).alias("at"))
    met = stabbed(written(spans, "versions"), points).select(
        *keys, "message_id", "seq", "sub", F.col("born.seq").alias("_seq"), F.col("born.sub").alias("_sub")
    )
    placed = running(written(met, "states"), keys, ["_seq", "_sub"], {"position": F.lit(1)}, policy=policy)
    given = F.coalesce("sub", F.lit(0)) if "sub" in events.columns else F.lit(0)
    rest = [c for c in events.columns if c not in {*keys, "message_id", "seq", "sub", "op"}]
    bodies = events.filter("op = 'append'").withColumn("sub", given.cast("bigint"))
    return bodies.join(placed, ["thread_id", "message_id", "seq", "sub"]).select(
        *keys, (F.col("position") - 1).alias("position"), "message_id", *rest
    )
