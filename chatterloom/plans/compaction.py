"""Which part of each thread is folded into its summary, now and over its history."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.config import CompactionConfig, Wording
from chatterloom.functions import text as X
from chatterloom.functions.model import TextFunction, apply_text_function
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, byte_pages, rows_in_spans, running
from chatterloom.operators.logs import upsert_latest
from chatterloom.operators.messages import thread_spans
from chatterloom.session import ship_package, written

PAGE_BYTES = 8 * 1024 * 1024
FAN_IN = 64
TURN_BLOCK = 65_536


# --- one check against the stored boundary -------------------------------------


def compaction_candidates(
    messages: DataFrame, summaries: DataFrame, cfg: CompactionConfig = CompactionConfig()
) -> DataFrame:
    """Threads whose unsummarized tail is due: start, tail length, fold count, tokens.

    Only threads with more than ``keep_last`` unsummarized rows reach the
    content join, and only their foldable rows are read into it.
    """
    spans = thread_spans(messages, summaries).withColumn("tail", F.col("hi") - F.col("lo"))
    due = spans.filter(F.col("tail") > cfg.keep_last).select(
        "thread_id", "lo", (F.col("hi") - cfg.keep_last).alias("hi"), "tail"
    )
    sized = messages.select("thread_id", "position", X.content_length(F.col("content")).alias("chars"))
    folded = rows_in_spans(sized, due).groupBy("thread_id", "lo", "hi", "tail").agg(
        X.tokens_from_chars(F.sum("chars"), cfg.chars_per_token).alias("tokens")
    )
    return folded.filter(
        (F.col("tokens") > cfg.max_tokens) | (F.col("tail") > cfg.max_messages)
    ).select(
        "thread_id",
        F.col("lo").alias("start"),
        F.col("tail").alias("tail_messages"),
        (F.col("hi") - F.col("lo")).alias("foldable_messages"),
        "tokens",
    )


def transcript_pages(
    messages: DataFrame,
    spans: DataFrame,
    page_bytes: int = PAGE_BYTES,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """``thread_id, page, pages, transcript``: lines of ``[lo, hi)`` per thread.

    A page holds about ``page_bytes``; pages joined with newlines in order are the
    whole transcript. Pages are laid out on sizes alone; bodies then meet them on
    (thread, position), which spreads a long thread evenly.
    """
    line = F.concat(X.transcript_role(F.col("type")), F.lit(": "), F.coalesce("content", F.lit(C.NON_TEXT)))
    sizes = messages.select("thread_id", "position", (F.octet_length(line) + 1).alias("_size"))
    inside = rows_in_spans(sizes, spans)
    placed = byte_pages(inside, ["thread_id"], ["position"], F.col("_size"), page_bytes, policy)
    lines = messages.select("thread_id", "position", line.alias("line"))
    return (
        lines.join(placed, ["thread_id", "position"])
        .groupBy("thread_id", "page", "pages")
        .agg(F.sort_array(F.collect_list(F.struct("position", "line"))).alias("lines"))
        .select("thread_id", "page", "pages", F.array_join(F.col("lines.line"), "\n").alias("transcript"))
    )


def transcript(
    messages: DataFrame, page_bytes: int = PAGE_BYTES, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Transcript of every whole thread, in pages."""
    spans = messages.groupBy("thread_id").agg(
        F.lit(0).cast("bigint").alias("lo"), F.count(F.lit(1)).alias("hi")
    )
    return transcript_pages(messages, spans, page_bytes, policy).drop("pages")


def _prompt(lead: Column, body: Column, wording: Wording) -> Column:
    """A complete prompt: instruction, which part this is, the part, the closing line."""
    number = F.concat(
        F.lit(wording.part_lead), (F.col("page") + 1).cast("string"),
        F.lit(wording.part_of), F.col("pages").cast("string"), F.lit(wording.part_end),
    )
    return F.concat(lead, number, body, F.lit(wording.prompt_tail))


def fold_segments(
    messages: DataFrame,
    summaries: DataFrame,
    cfg: CompactionConfig = CompactionConfig(),
    wording: Wording = Wording(),
    page_bytes: int = PAGE_BYTES,
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """Text to fold for each due thread, the prompt around it and the new count.

    Every page gets a complete prompt, with the existing summary in its update
    form; a thread of one page is part 1 of 1. Messages are only read; nothing is
    removed from them.
    """
    # Written: three uses, and its known size lets a short list be broadcast, so
    # that bodies of threads that are not due are never shuffled.
    due = written(
        compaction_candidates(messages, summaries, cfg)
        .join(summaries.select("thread_id", "summary"), "thread_id", "left")
        .select(
            "thread_id",
            F.col("start").alias("lo"),
            F.expr("start + foldable_messages").alias("hi"),
            F.coalesce("summary", F.lit("")).alias("existing"),
        ),
        "due",
    )
    pages = transcript_pages(messages, due.select("thread_id", "lo", "hi"), page_bytes, policy)
    facts = due.select("thread_id", "existing", F.col("hi").alias("summarized_count"))
    lead = F.when(F.col("existing") == "", F.lit(wording.fresh_lead)).otherwise(
        F.concat(F.lit(wording.update_lead), F.col("existing"), F.lit(wording.update_join))
    )
    return pages.join(facts, "thread_id").select(
        "thread_id", "page", "pages", "existing", "transcript",
        _prompt(lead, F.col("transcript"), wording).alias("prompt"), "summarized_count",
    )


def shorten(prompts: pd.Series) -> pd.Series:
    """Stand-in summarizer: the first 200 characters of the prompt."""
    return prompts.str.slice(0, 200)


def apply_summaries(
    segments: DataFrame, summarize: TextFunction = shorten, fan_in: int = FAN_IN, wording: Wording = Wording(),
    answers: str | None = None, model: str = "",
) -> DataFrame:
    """``thread_id, summary, summarized_count`` from a user function over prompts.

    Each page is summarized once. While a thread has several summaries, ``fan_in``
    consecutive ones at a time go into a merging prompt; a summary without a
    neighbour passes on as it is. The number of rounds is the logarithm of the page
    count, and each round is written. With ``answers``, a shared folder, every answer is
    kept as soon as its call is done, and a run that was cut off asks only what is missing.
    """
    columns = ["thread_id", "page", "pages", "summarized_count", "text"]
    asked = segments.withColumnRenamed("prompt", "text").select(*columns, F.lit(True).alias("due"))
    current = written(apply_text_function(asked, summarize, answers=answers, model=model).select(columns), "summaries")
    finished = current.filter("pages = 1")
    while not (several := current.filter("pages > 1")).isEmpty():
        merged = (
            several.groupBy(
                "thread_id", "summarized_count", F.expr(f"page div {fan_in}").alias("page"),
                F.expr(f"(pages + {fan_in - 1}) div {fan_in}").alias("pages"),
            )
            .agg(F.sort_array(F.collect_list(F.struct("page", "text"))).alias("parts"))
            .withColumn("due", F.size("parts") > 1)
        )
        joined = F.array_join(F.col("parts.text"), wording.section_rule)
        text = F.when(F.col("due"), _prompt(F.lit(wording.merge_lead), joined, wording)).otherwise(joined)
        prompts = merged.select("thread_id", "page", "pages", "summarized_count", text.alias("text"), "due")
        current = written(apply_text_function(prompts, summarize, answers=answers, model=model).select(columns), "summaries")
        finished = finished.unionByName(current.filter("pages = 1"))
    return finished.select("thread_id", F.col("text").alias("summary"), "summarized_count")


def advance_summaries(summaries: DataFrame, new: DataFrame, stamp: Column) -> DataFrame:
    """Write new summaries over the old ones and move the boundary."""
    fresh = new.select(
        "thread_id", "summary", F.col("summarized_count").cast("int"), stamp.alias("updated_at")
    )
    return upsert_latest(summaries, fresh, ["thread_id"], ["updated_at"])


# --- the rule applied at the end of every turn -----------------------------------


def turn_ends(
    messages: DataFrame, cfg: CompactionConfig = CompactionConfig(), policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """``thread_id, k, n, kept``: k-th turn end, messages so far, and the
    characters of all but the last ``keep_last`` of them.

    A message counts towards ``kept`` once ``keep_last`` more have followed, so
    its length is entered that much later in the order; one running sum over
    lengths and ends then gives both numbers without looking back.
    """
    counted = F.struct(
        (F.col("position") + cfg.keep_last).alias("at"),
        F.lit(0).alias("is_end"),
        X.content_length(F.col("content")).alias("chars"),
    )
    ended = F.struct(
        F.col("position").alias("at"), F.lit(1).alias("is_end"), F.lit(0).cast("bigint").alias("chars")
    )
    entries = F.when(
        X.ends_turn(F.col("type"), F.col("tool_calls")), F.array(counted, ended)
    ).otherwise(F.array(counted))
    steps = messages.select("thread_id", F.inline(entries))
    scanned = running(
        steps, ["thread_id"], ["at", "is_end"],
        {"kept": F.col("chars"), "k": F.col("is_end")}, policy=policy,
    )
    return scanned.filter("is_end = 1").select(
        "thread_id", (F.col("k") - 1).alias("k"), (F.col("at") + 1).alias("n"), "kept"
    )


_FOLDS = "array<struct<n: bigint, before: bigint, after: bigint>>"
_PIECE = 256


def _turn_blocks(ends: DataFrame, width: int) -> DataFrame:
    """Turn ends per (thread, block) as a sorted array of at most ``width``, whatever the limits are."""
    return ends.groupBy("thread_id", F.expr(f"k div {width}").alias("blk")).agg(
        F.sort_array(F.collect_list(F.struct("n", "kept"))).alias("own")
    )


def _fires(s: Column, chars: Column, e: Column, cfg: CompactionConfig) -> Column:
    """Whether turn end ``e`` folds, with the boundary at ``s``."""
    enough = (cfg.max_tokens + 1) * cfg.chars_per_token
    waiting = e["n"] - s
    return (waiting > cfg.keep_last) & ((e["kept"] - chars >= enough) | (waiting > cfg.max_messages))


def _folds(s: Column, chars: Column, cfg: CompactionConfig) -> Column:
    """Folds made inside a block that is entered with boundary ``s``.

    The accumulator of ``aggregate`` is copied at every element, so it must stay
    small: the block is taken in pieces, a first pass finds the state at the start
    of each piece, and the folds of each piece are then collected on their own.
    """
    last_piece = F.call_function("div", F.size("own") - 1, F.lit(_PIECE)).cast("int")

    def piece(i: Column) -> Column:
        return F.slice("own", i * _PIECE + 1, F.lit(_PIECE))

    def move(a: Column, e: Column) -> Column:
        moved = F.struct((e["n"] - cfg.keep_last).alias("s"), e["kept"].alias("chars"))
        return F.when(_fires(a["s"], a["chars"], e, cfg), moved).otherwise(a)

    def collect(a: Column, e: Column) -> Column:
        after = e["n"] - cfg.keep_last
        made = F.struct(e["n"].alias("n"), a["s"].alias("before"), after.alias("after"))
        moved = F.struct(
            after.alias("s"), e["kept"].alias("chars"), F.array_append(a["folds"], made).alias("folds")
        )
        return F.when(_fires(a["s"], a["chars"], e, cfg), moved).otherwise(a)

    starts = F.aggregate(
        F.sequence(F.lit(0), last_piece),
        F.struct(
            F.struct(s.alias("s"), chars.alias("chars")).alias("now"),
            F.array().cast("array<struct<s: bigint, chars: bigint>>").alias("seen"),
        ),
        lambda a, i: F.struct(
            F.aggregate(piece(i), a["now"], move).alias("now"),
            F.array_append(a["seen"], a["now"]).alias("seen"),
        ),
        lambda a: a["seen"],
    )

    def folds_of(start: Column, i: Column) -> Column:
        empty = F.array().cast(_FOLDS).alias("folds")
        state = F.struct(start["s"].alias("s"), start["chars"].alias("chars"), empty)
        return F.aggregate(piece(i), state, collect, lambda a: a["folds"])

    return F.flatten(F.transform(starts, folds_of))


def _next_folds(ends: DataFrame, cfg: CompactionConfig, policy: SplitPolicy) -> DataFrame:
    """``thread_id, k, n, kept, target``: the turn end that folds next after a fold at ``k``.

    Both limits only ever become true along a thread, so each is a search for the first
    turn end at or above a value. Ends and searched values are put in one order, and the
    ends before a value are its answer: a running count, however far apart two folds
    lie. ``k = -1`` stands for the thread's start. ``target`` may lie past the last end.
    """
    start = ends.select("thread_id").distinct().select(
        "thread_id", *[F.lit(v).cast("bigint").alias(c) for c, v in (("k", -1), ("n", cfg.keep_last), ("kept", 0))]
    )
    enough = (cfg.max_tokens + 1) * cfg.chars_per_token
    # After a fold at `n` the boundary is `n - keep_last`; at the start it is 0.
    late = F.col("n") - cfg.keep_last + cfg.max_messages + 1
    entry = lambda by, at, is_end: F.struct(
        F.lit(by).alias("by"), at.cast("bigint").alias("at"), F.lit(is_end).alias("is_end")
    )
    searched = F.array(entry(0, F.col("kept") + enough, 0), entry(1, F.greatest(late, F.col("n") + 1), 0))
    listed = F.array(entry(0, F.col("kept"), 1), entry(1, F.col("n"), 1))
    # A fold needs more than `keep_last` messages, at the start too: ends up to there never answer.
    able = F.when(F.col("n") > cfg.keep_last, listed).otherwise(F.slice(listed, 1, F.lit(0)))
    early = ends.filter(F.col("n") <= cfg.keep_last).groupBy("thread_id").agg(F.count(F.lit(1)).alias("early"))
    steps = start.unionByName(ends).select(
        "thread_id", "k", "n", "kept",
        F.inline(F.concat(searched, F.when(F.col("k") >= 0, able).otherwise(F.slice(listed, 1, F.lit(0))))),
    )
    placed = running(
        steps, ["thread_id", "by"], ["at", "is_end", "k"], {"before": F.col("is_end")}, policy=policy
    ).filter("is_end = 0")
    found = placed.groupBy("thread_id", "k").agg(
        F.first("n").alias("n"), F.first("kept").alias("kept"), F.min("before").alias("target")
    )
    skipped = F.coalesce("early", F.lit(0).cast("bigint"))
    return found.join(early, "thread_id", "left").select(
        "thread_id", "k", "n", "kept", F.greatest(F.col("target") + skipped, F.col("k") + 1).alias("target")
    )


def _block_exits(pointers: DataFrame, width: int) -> DataFrame:
    """Where a chain of folds that enters a block at ``k`` leaves it: its last fold, their number, the next target."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ignore_index=True)
        first, count = int(pdf["k"].iloc[0]), len(pdf)
        last, target = list(range(count)), pdf["target"].tolist()
        folds = [1] * count
        for i in range(count - 1, -1, -1):
            j = target[i] - first
            if j < count:
                last[i], target[i], folds[i] = last[j], target[j], folds[j] + 1
        return pdf.assign(n=pdf["n"].to_numpy()[last], kept=pdf["kept"].to_numpy()[last], target=target, folds=folds)

    ship_package(pointers.sparkSession)
    inside = pointers.filter("k >= 0").withColumn("blk", F.expr(f"k div {width}"))
    schema = "thread_id string, blk bigint, k bigint, n bigint, kept bigint, target bigint, folds bigint"
    columns = ["thread_id", "blk", "k", "n", "kept", "target"]
    return inside.select(columns).groupBy("thread_id", "blk").applyInPandas(leave, schema)


def _block_entries(ends: DataFrame, cfg: CompactionConfig, width: int, policy: SplitPolicy) -> DataFrame:
    """State at the start of each block after the first, for threads of several blocks.

    Every turn end points at the next fold. Inside a block chains are followed to
    their exits, blocks in parallel; the exits are then doubled until the chain
    from the thread's start has passed all blocks: as many rounds as the logarithm of
    the blocks of the longest thread, each a join on (thread, turn end).
    """
    pointers = written(_next_folds(ends, cfg, policy), "next-folds")
    exits = written(_block_exits(pointers, width), "block-exits")
    marked = pointers.filter("k = -1").select("thread_id", F.col("target").alias("k"))
    jump = exits.select("thread_id", "k", "target")
    most = exits.agg(F.max("blk")).first()[0]
    for _ in range((most or 0).bit_length()):
        onward = marked.join(jump, ["thread_id", "k"]).select("thread_id", F.col("target").alias("k"))
        marked = written(marked.unionByName(onward), "entered-blocks")
        far = jump.select("thread_id", F.col("k").alias("target"), F.col("target").alias("_far"))
        jump = written(
            jump.join(far, ["thread_id", "target"]).select("thread_id", "k", F.col("_far").alias("target")), "doubled-exits"
        )
    entered = exits.join(marked, ["thread_id", "k"]).select("thread_id", "blk", "n", "kept", "folds")
    # One row per block of `width` turn ends: few enough for a window over a thread.
    blocks = exits.select("thread_id", "blk").distinct().join(entered, ["thread_id", "blk"], "left")
    past = Window.partitionBy("thread_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("n").isNotNull(), F.struct("n", "kept")), ignorenulls=True).over(past)
    zero = F.lit(0).cast("bigint")
    return blocks.select(
        "thread_id", "blk", before.alias("_last"), F.coalesce(F.sum("folds").over(past), zero).alias("folds_before")
    ).filter("blk > 0").select(
        "thread_id", "blk",
        F.coalesce(F.col("_last.n") - cfg.keep_last, zero).alias("s"),
        F.coalesce("_last.kept", zero).alias("chars"),
        "folds_before",
    )


def compaction_boundaries(
    messages: DataFrame,
    cfg: CompactionConfig = CompactionConfig(),
    policy: SplitPolicy = DEFAULT_SPLIT,
    width: int = TURN_BLOCK,
) -> DataFrame:
    """Every fold of a thread's life: number, turn end, boundary before and after.

    The recurrence is sequential in a thread but only over turn ends, and a long
    thread is cut into blocks of ``width`` turn ends that run in parallel. The width
    does not depend on the limits, so ``max_messages`` may be as large as one likes.
    """
    return _boundaries_of(written(turn_ends(messages, cfg, policy), "turn-ends"), cfg, width, policy)


def _boundaries_of(ends: DataFrame, cfg: CompactionConfig, width: int, policy: SplitPolicy) -> DataFrame:
    """Boundaries from turn ends."""
    blocks = _turn_blocks(ends, width)
    zero = F.lit(0).cast("bigint")
    # Threads of one block start from nothing; the branch of longer ones is usually empty.
    long = ends.filter(F.col("k") == width).select("thread_id")
    if long.isEmpty():
        found = blocks.select("*", *[zero.alias(c) for c in ("s", "chars", "folds_before")])
    else:
        chained = ends.join(long, "thread_id", "left_semi")
        found = blocks.join(_block_entries(chained, cfg, width, policy), ["thread_id", "blk"], "left")
    lost = F.raise_error(F.concat(F.lit("no entry state for a block of thread "), "thread_id"))
    entered = found.select(
        "thread_id", "own",
        *[F.coalesce(F.col(c), F.when(F.col("blk") > 0, lost).otherwise(zero)).alias(c) for c in ("s", "chars", "folds_before")],
    )
    # The generator takes the expression itself: over a named column the optimizer
    # would add a filter on its size and fold every block a second time.
    return entered.select(
        "thread_id", "folds_before", F.posexplode(_folds(F.col("s"), F.col("chars"), cfg)).alias("i", "f")
    ).select(
        "thread_id",
        (F.col("folds_before") + F.col("i") + 1).cast("bigint").alias("boundary_no"),
        F.col("f.n").alias("at_message"),
        F.col("f.before").alias("previous_count"),
        F.col("f.after").alias("summarized_count"),
    )


def message_segments(messages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Messages with the number of the fold that took them; the open tail is null."""
    spans = boundaries.select(
        "thread_id", F.col("previous_count").alias("lo"), F.col("summarized_count").alias("hi"),
        F.col("boundary_no").alias("segment"),
    )
    last = boundaries.groupBy("thread_id").agg(F.max("summarized_count").alias("lo"))
    sizes = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("hi"))
    tails = sizes.join(last, "thread_id", "left").select(
        "thread_id", F.coalesce("lo", F.lit(0).cast("bigint")).alias("lo"), "hi",
        F.lit(None).cast("bigint").alias("segment"),
    )
    return rows_in_spans(messages, spans.unionByName(tails)).select(*messages.columns, "segment")


def context_size_per_turn(
    messages: DataFrame,
    cfg: CompactionConfig = CompactionConfig(),
    notes: DataFrame | None = None,
    policy: SplitPolicy = DEFAULT_SPLIT,
    width: int = TURN_BLOCK,
) -> DataFrame:
    """Stored messages against messages a model sees, for each finished turn.

    ``notes(thread_id, note_tokens)`` is optional; note text is never folded, so
    it is reported apart. ``opens_on_tool`` marks a window whose first message is
    a tool result cut off from its call.
    """
    ends = written(turn_ends(messages, cfg, policy), "turn-ends")
    folds = written(_boundaries_of(ends, cfg, width, policy), "boundaries")
    # The boundary `before` holds for turn ends after the previous fold up to this one.
    since = lambda s: F.when(s == 0, F.lit(0).cast("bigint")).otherwise(s + cfg.keep_last + 1)
    closed = folds.select(
        "thread_id", since(F.col("previous_count")).alias("lo"),
        (F.col("at_message") + 1).alias("hi"), F.col("previous_count").alias("summarized"),
    )
    last = folds.groupBy("thread_id").agg(F.max("summarized_count").alias("summarized"))
    zero = F.lit(0).cast("bigint")
    opened = (
        ends.groupBy("thread_id").agg((F.max("n") + 1).alias("hi"))
        .join(last, "thread_id", "left")
        .select("thread_id", since(F.coalesce("summarized", zero)).alias("lo"), "hi",
                F.coalesce("summarized", zero).alias("summarized"))
    )
    spans = closed.unionByName(opened)
    seen = rows_in_spans(ends, spans, at="n").select(
        "thread_id",
        (F.col("k") + 1).alias("turn_no"),
        (F.col("n") - 1).alias("stored"),
        "summarized",
        (F.col("n") - 1 - F.col("summarized")).alias("_tail"),
    )
    tools = messages.filter(F.col("type") == "tool").select(
        "thread_id", F.col("position").alias("summarized"), F.lit(True).alias("_tool")
    )
    marked = seen.join(tools, ["thread_id", "summarized"], "left")
    if notes is None:
        note_tokens = F.lit(0).cast("bigint")
    else:
        marked = marked.join(notes.select("thread_id", "note_tokens"), "thread_id", "left")
        note_tokens = F.coalesce("note_tokens", zero)
    system = ((F.col("summarized") > 0) | (note_tokens > 0)).cast("bigint")
    return marked.select(
        "thread_id", "turn_no", "stored", "summarized",
        (F.col("_tail") + system).alias("seen"),
        F.coalesce("_tool", F.lit(False)).alias("opens_on_tool"),
        note_tokens.alias("note_tokens"),
    )


# --- routing -------------------------------------------------------------------------


def route_turns(
    messages: DataFrame, summaries: DataFrame, cfg: CompactionConfig = CompactionConfig()
) -> DataFrame:
    """Next step per thread: ``tools``, ``summarize`` or ``end``."""
    calls = X.call_count(F.col("tool_calls")) > 0
    last = messages.groupBy("thread_id").agg(
        F.max("position").alias("_last"), F.max(F.when(calls, F.col("position"))).alias("_call")
    )
    due = compaction_candidates(messages, summaries, cfg).select("thread_id", F.lit(True).alias("_due"))
    return last.join(due, "thread_id", "left").select(
        "thread_id",
        F.when(F.col("_call") == F.col("_last"), "tools")
        .when(F.col("_due"), "summarize")
        .otherwise("end")
        .alias("route"),
    )
