"""One registered query per operator, over tables derived from the shared data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom import CompactionConfig
from chatterloom.config import DEFAULT_USERNAME, NEW_CHAT_TITLE
from chatterloom.functions import text as X
from chatterloom.operators import logs, messages as msg, reports, retention, scope
from chatterloom.operators.blocks import SplitPolicy
from chatterloom.operators.search_index import TextIndex
from chatterloom.plans import compaction, context, edits, lengths, memory
from chatterloom.session import shared_folder, written
from chatterloom.sources import daily
from chatterloom.sources import tables as io
from chatterloom.sources.fixtures import Tables, conversation_rows
from chatterloom.streaming import compaction as stream_compactor
from chatterloom.streaming import events as streams
from chatterloom.streaming.snapshot import KeyedSnapshot, upsert_batches

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {}

# Threads of the short fixture never reach the default limits.
SMALL = CompactionConfig(max_tokens=100, max_messages=4, keep_last=2)
# Small pages and a small fan-in take the way of very long threads.
PAGED, FEW = 256, 4
ONE_USER = "user_3"
# Limits by tokens only, blocks of few turn ends and positions, and a share that some days reach.
BY_TOKENS = CompactionConfig(max_tokens=100, max_messages=1_000_000, keep_last=2)
CHAINED_WIDTH, KEPT_WIDTH, LEAST_SHARE = 8, 16, 0.875
CHECKED_TABLES = ("customer", "documents", "events", "conversations", "labels")


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    BUILDERS[build.__name__] = build
    REGISTRY[build.__name__] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    return build


# --- sources, sinks, mutations ---------------------------------------------------


@query
def load_tables(t: Tables) -> DataFrame:
    """Written snapshots come back with declared schemas and defaults."""
    folder = shared_folder(t.spark, "tables")
    io.write_table(t.user_session.drop("username"), f"{folder}/session")
    return io.load_tables(t.spark, folder, ["session"], views=False)["session"]


@query
def load_all_tables(t: Tables) -> DataFrame:
    """Every stored table written, loaded and counted; columns added later are filled."""
    folder = shared_folder(t.spark, "tables")
    stored = {
        "user_account": t.user_account, "profile": t.profile.drop("username"), "session": t.user_session.drop("username"),
        "message_event": t.message_event, "message": t.message, "summary_context": t.summary, "note_event": _note_log(t),
        "note": t.note, "checkpoint": t.checkpoint,
    }
    for name, df in stored.items():
        io.write_table(df, f"{folder}/{name}")
    loaded = io.load_tables(t.spark, folder, views=False)
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows"), F.count(df.columns[-1]).alias("last_column_filled")).select(
            F.lit(name).alias("table_name"), F.lit(df.columns[-1]).alias("last_column"), "rows", "last_column_filled"
        )
        for name, df in loaded.items()
    ]
    return reduce(DataFrame.unionByName, counts)


@query
def append_log(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "log")
    io.append_log(t.session_event, folder)
    return t.spark.read.parquet(folder).groupBy("dt", "op").agg(F.count(F.lit(1)).alias("events"))


@query
def upsert_latest(t: Tables) -> DataFrame:
    """Every user message proposes a summary; the last one per thread wins."""
    updates = t.message.filter(F.col("type") == "human").select(
        "thread_id",
        F.col("message_id").alias("summary"),
        F.col("position").cast("int").alias("summarized_count"),
        F.col("ts").alias("updated_at"),
    )
    return logs.upsert_latest(t.summary, updates, ["thread_id"], ["updated_at"])


@query
def insert_if_absent(t: Tables) -> DataFrame:
    """Sessions for all checkpoint threads; existing sessions stay as they are."""
    seen = t.raw("events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    new = seen.select(
        F.col("user_id").cast("string").alias("thread_id"),
        F.lit(NEW_CHAT_TITLE).alias("title"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(0).alias("message_count"),
        F.lit(DEFAULT_USERNAME).alias("username"),
    )
    return logs.insert_if_absent(t.user_session, new, ["thread_id"])


@query
def ensure_profiles(t: Tables) -> DataFrame:
    """Default profile seeded, and every account has at least one profile."""
    stamp = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
    return logs.profiles_for_accounts(logs.with_default_profile(t.profile, stamp), t.user_account)


@query
def register_accounts(t: Tables) -> DataFrame:
    owners = t.user_session.groupBy("username").agg(F.min("created_at").alias("created_at"))
    taken = t.raw("customer").select(
        F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t")).alias("username"),
        F.expr("timestamp_ntz'2030-01-01 00:00:00'").alias("created_at"),
    )
    blank = owners.select(F.lit("  ").alias("username"), "created_at")
    return logs.register_accounts(t.user_account, owners.unionByName(taken).unionByName(blank))


@query
def entity_fold(t: Tables) -> DataFrame:
    return logs.fold_entity_log(t.session_event, "thread_id", policy=t.policy)


@query
def profile_fold(t: Tables) -> DataFrame:
    """Profiles out of the event log; every second create carries a name."""
    named = F.concat(F.lit("Profile "), F.col("seq").cast("string"))
    log = t.session_event.select(
        F.col("thread_id").alias("profile_id"), "op",
        F.when((F.col("op") == "create") & (F.col("seq") % 2 == 0), named).otherwise(F.col("title")).alias("name"),
        F.concat(F.lit("user_"), (F.col("thread_id").cast("bigint") % 7).cast("string")).alias("username"), "ts", "seq",
    )
    return logs.fold_profile_log(log, policy=t.policy)


@query
def cascade_delete(t: Tables) -> DataFrame:
    """Rows left per table and thread after threads under four messages are dropped."""
    short = t.session.filter(F.col("message_count") < 4)
    left = retention.cascade_delete(
        {
            "session": t.session, "summary_context": t.summary, "message_event": t.message_event, "message": t.message,
            "checkpoint": t.checkpoint,
        },
        short,
    )
    parts = [
        df.groupBy("thread_id").agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "thread_id", "rows"
        )
        for name, df in left.items()
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def delete_profiles(t: Tables) -> DataFrame:
    return retention.decide_profile_deletes(t.profile, t.profile_request, t.policy)


@query
def notes_after_profile_delete(t: Tables) -> DataFrame:
    profiles, notes, _ = retention.delete_profiles(t.profile, t.note, t.profile_request, t.policy)
    return reports.profile_note_counts(profiles, notes)


@query
def delete_notes(t: Tables) -> DataFrame:
    return retention.delete_notes(t.note, t.note_delete)


@query
def evolve_schema(t: Tables) -> DataFrame:
    old = t.profile.drop("username").withColumn(
        "name", F.when(F.col("profile_id").startswith("src"), F.col("name"))
    )
    return io.evolve_schema(old, {"name": "Default", "username": DEFAULT_USERNAME})


@query
def integrity_audit(t: Tables) -> DataFrame:
    """Checkpoints without a session, summaries without a session, doubled ids, holes."""
    checked = {
        "session": t.user_session,
        "summary_context": t.summary.withColumn(
            "summary", F.when(F.col("summary") != "", F.col("summary"))
        ),
        "checkpoint": t.checkpoint,
        "note": t.note.unionByName(t.note.join(t.note_delete, ["profile_id", "note_id"], "left_semi").select(t.note.columns)),
    }
    return retention.integrity_audit(
        checked,
        [("summary_context", "session", "thread_id"), ("checkpoint", "session", "thread_id")],
        t.policy,
    )


def _note_log(t: Tables) -> DataFrame:
    put = t.note.select(
        "profile_id", "note_id", F.lit("put").alias("op"), "text", "created_at", "source_thread_id",
        F.lit(1).cast("bigint").alias("seq"),
    )
    gone = t.note_delete.select("profile_id", "note_id", F.lit("delete").alias("op"), F.lit(2).cast("bigint").alias("seq"))
    return put.unionByName(gone, allowMissingColumns=True)


@query
def compact_log(t: Tables) -> DataFrame:
    folder = shared_folder(t.spark, "compact")
    io.compact_log(_note_log(t), ["profile_id", "note_id"], folder)
    return t.spark.read.parquet(folder).select("profile_id", "note_id", "text", "created_at")


@query
def compact_days(t: Tables) -> DataFrame:
    """A log by days; only the days with enough rows out of date are written anew."""
    folder = shared_folder(t.spark, "log-days")
    io.append_log(t.session_event, folder)
    daily.compact_days(t.spark, folder, ["thread_id"], least_share=LEAST_SHARE)
    return t.spark.read.parquet(folder).select("dt", "thread_id", "op", "seq")


# --- projections, filters, scalars -----------------------------------------------


@query
def scope_to_user(t: Tables) -> DataFrame:
    return scope.scope_to_user(t.session, ONE_USER)


@query
def search_titles(t: Tables) -> DataFrame:
    return scope.search_titles(t.session, "^[a-m].*(an|er)").select("thread_id", "title")


@query
def search_notes(t: Tables) -> DataFrame:
    return scope.search_notes(t.note, "th(e|in)\\s+[aeiou]").select("profile_id", "note_id")


@query
def search_notes_indexed(t: Tables) -> DataFrame:
    """The same search through trigrams of the stored notes."""
    folder = shared_folder(t.spark, "notes")
    io.write_table(t.note, f"{folder}/note")
    index = TextIndex(f"{folder}/trigrams", f"{folder}/note", "text")
    index.refresh(t.spark)
    return index.search(t.spark, "th(e|in)\\s+[aeiou]").select("profile_id", "note_id")


@query
def lookup_with_default(t: Tables) -> DataFrame:
    keys = t.thread_profile
    named = scope.profile_names_for(keys, t.profile.filter(F.col("username") != ONE_USER))
    titled = scope.titles_for(named, t.user_session)
    return scope.summaries_for(titled, t.summary)


@query
def message_text(t: Tables) -> DataFrame:
    return msg.with_text(t.message).select(
        "message_id", "text", X.has_image_note(F.col("text")).alias("has_image_note")
    )


@query
def describe_images(t: Tables) -> DataFrame:
    return msg.describe_images(t.message, t.image_description).select("message_id", "content")


@query
def visible_messages(t: Tables) -> DataFrame:
    """Shown messages after the tool results have been appended to the log."""
    log = _log_with_tools(t)
    return scope.visible_messages(logs.fold_messages(log, policy=t.policy)).select(
        "thread_id", "position", X.display_role(F.col("type")).alias("role"), "message_id"
    )


@query
def normalize_username(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" \t"), F.upper("c_name"), F.lit("\n "))
    return t.raw("customer").select("c_custkey", X.normalize_username(raw).alias("username"))


@query
def pseudonymize(t: Tables) -> DataFrame:
    return scope.pseudonymize(t.session, "pepper")


@query
def auto_title(t: Tables) -> DataFrame:
    return msg.auto_title(t.message)


@query
def auto_title_with_image(t: Tables) -> DataFrame:
    """Titles when an image note stands behind every user text: as without it."""
    noted = X.with_image_note(F.col("content"), F.concat(F.lit("img-"), "message_id"))
    shown = F.when(F.col("type") == "human", noted).otherwise(F.col("content"))
    return msg.auto_title(t.message.withColumn("content", shown))


@query
def note_fields(t: Tables) -> DataFrame:
    """Notes read back from store documents, with the time missing in every third."""
    store = scope.store_rows(
        t.note.withColumn(
            "created_at", F.when(F.col("note_id").cast("bigint") % 3 > 0, F.col("created_at"))
        )
    )
    return scope.notes_from_store(store).select("profile_id", "note_id", "text", "created_at", "source_thread_id")


@query
def namespace_delete(t: Tables) -> DataFrame:
    store = scope.store_rows(t.note)
    gone = t.profile.filter(F.col("username") == ONE_USER)
    left = scope.drop_profile_namespace(store, gone)
    return left.select(F.array_join("namespace", "/").alias("namespace"), "key")


@query
def namespace_notes(t: Tables) -> DataFrame:
    found = scope.notes_in_namespace(scope.store_rows(t.note), ["src4", "notes"])
    return found.select(F.array_join("namespace", "/").alias("namespace"), "key", F.col("value.text").alias("text"))


# --- joins -----------------------------------------------------------------------


@query
def scoped_checkpoint_count(t: Tables) -> DataFrame:
    return reports.scoped_checkpoint_count(t.checkpoint_key, t.user_session)


@query
def scoped_checkpoint_count_user(t: Tables) -> DataFrame:
    return reports.scoped_checkpoint_count(t.checkpoint_key, t.user_session, ONE_USER)


@query
def top_threads(t: Tables) -> DataFrame:
    return reports.top_threads(t.checkpoint_key, t.user_session)


@query
def top_threads_user(t: Tables) -> DataFrame:
    return reports.top_threads(t.checkpoint_key, t.user_session, ONE_USER)


@query
def session_index(t: Tables) -> DataFrame:
    return scope.latest_first(reports.session_index(t.session, t.summary), "thread_id")


@query
def profile_note_counts(t: Tables) -> DataFrame:
    return scope.smallest_first(reports.profile_note_counts(t.profile, t.live_note), "note_count", "profile_id")


@query
def mark_summarized(t: Tables) -> DataFrame:
    return msg.mark_summarized(t.message, t.summary).select("thread_id", "position", "is_summarized")


@query
def semi_scope(t: Tables) -> DataFrame:
    return scope.semi_scope(t.message, t.session, ONE_USER).select("thread_id", "position", "message_id")


@query
def thread_state_asof(t: Tables) -> DataFrame:
    """Every thread as it stood at half of its log."""
    tops = t.message_event.groupBy("thread_id").agg(F.max("seq").alias("top"))
    requests = tops.select(
        F.concat(F.lit("r"), "thread_id").alias("request_id"), "thread_id", F.expr("top div 2").alias("seq")
    )
    state = edits.thread_state_asof(t.message_event, requests, t.policy)
    return state.select("request_id", "thread_id", "position", "message_id", "content")


@query
def thread_state_each_event(t: Tables) -> DataFrame:
    """Every thread as it stood after each event of its log."""
    requests = t.message_event.select(
        F.concat_ws("-", "thread_id", "seq").alias("request_id"), "thread_id", "seq"
    )
    state = edits.thread_state_asof(t.message_event, requests, t.policy)
    return state.select("request_id", "thread_id", "position", "message_id", F.length("content").cast("bigint").alias("chars"))


# --- aggregations -------------------------------------------------------------------


@query
def overview_counts(t: Tables) -> DataFrame:
    return reports.overview_counts(t.user_account, t.user_session, t.checkpoint_key, t.profile)


@query
def overview_counts_user(t: Tables) -> DataFrame:
    return reports.overview_counts(t.user_account, t.user_session, t.checkpoint_key, t.profile, ONE_USER)


@query
def checkpoint_distribution(t: Tables) -> DataFrame:
    return reports.checkpoint_distribution(t.checkpoint_key, t.user_session)


@query
def role_counts(t: Tables) -> DataFrame:
    return msg.role_counts(t.long_message)


@query
def token_totals(t: Tables) -> DataFrame:
    return msg.token_totals(t.message)


@query
def note_metrics(t: Tables) -> DataFrame:
    return reports.note_metrics(t.profile, t.live_note)


@query
def thread_overview(t: Tables) -> DataFrame:
    """Summaries of the long threads against the short ones: some boundaries overrun."""
    return reports.thread_overview(
        t.message, t.long_summary.unionByName(t.summary.join(t.long_summary, "thread_id", "left_anti")),
        t.checkpoint_key,
    )


@query
def thread_tags(t: Tables) -> DataFrame:
    return reports.thread_tags(t.message, t.summary)


@query
def table_report(t: Tables) -> DataFrame:
    paths = {name: f"{t.directory}/{name}.parquet" for name in CHECKED_TABLES}
    return reports.storage_by_size(reports.table_report(t.spark, paths))


@query
def table_rows(t: Tables) -> DataFrame:
    paths = {name: f"{t.directory}/{name}.parquet" for name in CHECKED_TABLES}
    report = reports.table_report(t.spark, paths)
    return scope.smallest_first(report.select("table_name", "rows"), "rows", "table_name")


@query
def dead_rows(t: Tables) -> DataFrame:
    log = t.message_event
    both = logs.dead_rows(log, logs.fold_messages(log, policy=t.policy), "message_event").unionByName(
        logs.dead_rows(_note_log(t), logs.fold_notes(_note_log(t)), "note_event")
    )
    return scope.largest_first(both, "dead_rows", "table_name")


@query
def message_count(t: Tables) -> DataFrame:
    return msg.message_count(t.message)


@query
def fold_messages(t: Tables) -> DataFrame:
    return logs.fold_messages(t.message_event, policy=t.policy).select(
        "thread_id", "position", "message_id", "type", "content"
    )


@query
def notes_context(t: Tables) -> DataFrame:
    return context.notes_context(t.live_note, policy=t.policy)


@query
def notes_context_plain(t: Tables) -> DataFrame:
    return context.notes_context(t.live_note, with_ids=False, policy=t.policy)


@query
def transcript(t: Tables) -> DataFrame:
    return compaction.transcript(t.message)


@query
def last_human(t: Tables) -> DataFrame:
    return msg.last_human(t.message)


# --- windows ------------------------------------------------------------------------


@query
def message_index(t: Tables) -> DataFrame:
    return msg.message_index(t.message)


@query
def cumulative_chars(t: Tables) -> DataFrame:
    return msg.cumulative_chars(t.long_message, t.policy)


@query
def unsummarized_tail(t: Tables) -> DataFrame:
    return msg.unsummarized_tail(t.message, t.summary).select("thread_id", "position", "message_id")


@query
def foldable_split(t: Tables) -> DataFrame:
    return msg.foldable_split(t.long_message, t.long_summary).select(
        "thread_id", "position", "message_id", "foldable"
    )


@query
def active_session(t: Tables) -> DataFrame:
    return reports.active_session(t.session)


@query
def active_session_after_delete(t: Tables) -> DataFrame:
    """Next session per user once the active ones are deleted."""
    gone = reports.active_session(t.session)
    return reports.active_session(retention.cascade_delete({"session": t.session}, gone)["session"])


@query
def checkpoint_chain(t: Tables) -> DataFrame:
    return reports.checkpoint_chain(t.checkpoint, t.policy)


@query
def truncate_from(t: Tables) -> DataFrame:
    edit = t.message.filter(F.col("type") == "human").groupBy("thread_id").agg(
        F.max("position").alias("edit_position")
    ).filter(F.col("edit_position") > 1)
    kept, removed = msg.truncate_from(t.message, edit)
    return kept.select("thread_id", "position", F.lit("kept").alias("side")).unionByName(
        removed.select("thread_id", "position", F.lit("removed").alias("side"))
    )


# --- orderings ----------------------------------------------------------------------


@query
def sessions_by_recency(t: Tables) -> DataFrame:
    return scope.latest_first(t.session.select("thread_id", "title", "updated_at", "message_count"), "thread_id")


@query
def profiles_by_recency(t: Tables) -> DataFrame:
    return scope.latest_first(t.profile, "profile_id")


@query
def oldest_notes(t: Tables) -> DataFrame:
    return scope.oldest_notes_first(t.live_note).select("profile_id", "note_id", "created_at")


@query
def one_profile_per_user(t: Tables) -> DataFrame:
    return scope.one_profile_per_user(t.profile)


# --- set operations, memory dataflow ---------------------------------------------------


def _log_with_tools(t: Tables) -> DataFrame:
    return _with_answers(t, t.message_event)


def _with_answers(t: Tables, log: DataFrame) -> DataFrame:
    """The log with a tool message after every call of its current messages."""
    state = logs.fold_messages(log, policy=t.policy, keep_seq=True)
    effects = memory.tool_call_effects(state, t.thread_profile)
    answered = logs.append_messages(log, memory.tool_messages_of(effects).drop("tool_call_id"))
    return written(answered, "log-with-tools")


@query
def append_messages(t: Tables) -> DataFrame:
    return logs.fold_messages(_log_with_tools(t), policy=t.policy).select(
        "thread_id", "position", "message_id", "type", "content"
    )


@query
def append_messages_dense(t: Tables) -> DataFrame:
    """Twelve calls on every calling message, in a log numbered without gaps."""
    twelve = F.expr("""transform(sequence(0, 11), i -> struct(concat(message_id, '-c', i) AS id, 'search_web' AS name,
        map('query', message_id) AS args))""")
    log = t.message.withColumnRenamed("position", "seq").withColumns({
        "op": F.lit("append"), "tool_calls": F.when(X.call_count(F.col("tool_calls")) > 0, twelve),
    })
    return logs.fold_messages(_with_answers(t, log), policy=t.policy).select(
        "thread_id", "position", "message_id", "type", "content"
    )


@query
def assemble_context(t: Tables) -> DataFrame:
    return context.assemble_context(
        t.message, t.summary, t.live_note, t.thread_profile, policy=t.policy
    ).select("profile_id", "thread_id", "position", "part", "type", "content")


@query
def assemble_context_requested(t: Tables) -> DataFrame:
    """Text for the one session that each user has open."""
    open_now = t.thread_profile.join(reports.active_session(t.session), "thread_id", "left_semi")
    return context.assemble_context_requested(
        t.message, t.summary, t.live_note, open_now, policy=t.policy
    ).select("thread_id", "position", "part", "type", "content")


@query
def compaction_candidates(t: Tables) -> DataFrame:
    return compaction.compaction_candidates(t.long_message, t.long_summary)


@query
def compaction_candidates_small(t: Tables) -> DataFrame:
    return compaction.compaction_candidates(t.message, t.summary, SMALL)


@query
def fold_segments(t: Tables) -> DataFrame:
    return compaction.fold_segments(t.long_message, t.long_summary)


@query
def fold_segments_paged(t: Tables) -> DataFrame:
    return compaction.fold_segments(t.long_message, t.long_summary, SMALL, page_bytes=PAGED, policy=t.policy)


def digests(prompts: pd.Series) -> pd.Series:
    """Stand-in summarizer that shows every character of its prompt."""
    return prompts.map(lambda prompt: sha256(prompt.encode()).hexdigest())


@query
def apply_summaries_paged(t: Tables) -> DataFrame:
    """Summaries of threads with many pages, merged a few at a time."""
    segments = compaction.fold_segments(t.long_message, t.long_summary, SMALL, page_bytes=PAGED, policy=t.policy)
    return compaction.apply_summaries(segments, digests, fan_in=FEW)


@query
def apply_summaries(t: Tables) -> DataFrame:
    """Summaries after one round with the stand-in summarizer."""
    segments = compaction.fold_segments(t.message, t.summary, SMALL)
    new = compaction.apply_summaries(segments)
    stamp = F.expr("timestamp_ntz'2025-01-01 00:00:00'")
    return compaction.advance_summaries(t.summary, new, stamp)


def silent(prompts: pd.Series) -> pd.Series:
    raise AssertionError(f"{len(prompts)} prompts asked again")


@query
def apply_summaries_resumed(t: Tables) -> DataFrame:
    """As ``apply_summaries_paged``, from answers that an earlier run kept: nothing is asked again."""
    segments = compaction.fold_segments(t.long_message, t.long_summary, SMALL, page_bytes=PAGED, policy=t.policy)
    segments, answers = written(segments, "segments"), shared_folder(t.spark, "answers")
    compaction.apply_summaries(segments, digests, fan_in=FEW, answers=answers, model="digests")
    return compaction.apply_summaries(segments, silent, fan_in=FEW, answers=answers, model="digests")


@query
def compaction_candidates_kept(t: Tables) -> DataFrame:
    """Candidates out of kept sums: three appends, of messages whose questions are written over later."""
    drafted = F.when(F.col("type") == "human", F.concat(F.coalesce("content", F.lit("")), F.lit(" (draft)")))
    first = t.long_message.withColumn("content", F.coalesce(drafted, "content"))
    part = F.expr("pmod(position div 50, 3)")
    blocks = lengths.length_blocks(first.filter(part == 0), KEPT_WIDTH)
    for later in (1, 2):
        blocks = written(lengths.advance(blocks, first.filter(part == later), KEPT_WIDTH), "length-blocks")
    over = t.long_message.filter(F.col("type") == "human").select(
        "thread_id", "position", F.concat(F.coalesce("content", F.lit("")), F.lit(" (draft)")).alias("before"),
        F.col("content").alias("after"),
    )
    blocks = written(lengths.edited(blocks, over, KEPT_WIDTH), "length-blocks")
    return lengths.candidates_from_blocks(blocks, t.long_message, t.long_summary, SMALL, KEPT_WIDTH)


@query
def compaction_boundaries_chained(t: Tables) -> DataFrame:
    """Blocks of a few turn ends, with a message limit far beyond them."""
    return compaction.compaction_boundaries(t.long_message, BY_TOKENS, t.policy, width=CHAINED_WIDTH)


@query
def compaction_boundaries(t: Tables) -> DataFrame:
    return compaction.compaction_boundaries(t.long_message, policy=t.policy)


@query
def compaction_boundaries_small(t: Tables) -> DataFrame:
    return compaction.compaction_boundaries(t.message, SMALL, t.policy)


@query
def message_segments(t: Tables) -> DataFrame:
    folds = compaction.compaction_boundaries(t.message, SMALL, t.policy)
    return compaction.message_segments(t.message, folds).select("thread_id", "position", "segment")


@query
def route_turns(t: Tables) -> DataFrame:
    return compaction.route_turns(t.message, t.summary, SMALL)


@query
def dispatch_tool_calls(t: Tables) -> DataFrame:
    effects = memory.tool_call_effects(t.message, t.thread_profile)
    return effects.select(
        "thread_id", "profile_id", "message_id", "call_no", "tool_call_id", "tool", "action", "note_id", "answer"
    )


@query
def tool_note_events(t: Tables) -> DataFrame:
    effects = memory.tool_call_effects(t.message, t.thread_profile)
    return memory.note_events_of(effects)


@query
def tool_profile_touches(t: Tables) -> DataFrame:
    effects = memory.tool_call_effects(t.message, t.thread_profile)
    return memory.touch_profiles(t.profile, memory.profile_touches_of(effects))


@query
def extract_notes(t: Tables) -> DataFrame:
    return memory.extract_notes(t.extraction, msg.last_human(t.long_message))


@query
def extraction_prompts(t: Tables) -> DataFrame:
    return memory.extraction_prompts(t.message, t.thread_profile)


@query
def extraction_touches(t: Tables) -> DataFrame:
    return memory.extraction_touches(t.extraction, msg.last_human(t.long_message))


@query
def final_responses(t: Tables) -> DataFrame:
    return msg.final_responses(t.message, policy=t.policy)


@query
def regenerate(t: Tables) -> DataFrame:
    """State of every thread after its last user message is edited."""
    edit = t.message.groupBy("thread_id").agg(F.max("ts").alias("ts")).select(
        "thread_id",
        F.concat(F.lit("edit-"), "thread_id").alias("message_id"),
        F.concat(F.lit("edited question in "), "thread_id").alias("content"),
    )
    log = written(edits.regenerate(t.message_event, edit, t.policy), "edited-log")
    return logs.fold_messages(log, policy=t.policy).select("thread_id", "position", "message_id", "content")


@query
def context_size_per_turn(t: Tables) -> DataFrame:
    return compaction.context_size_per_turn(t.long_message, policy=t.policy)


@query
def message_composition(t: Tables) -> DataFrame:
    return msg.message_composition(t.message, t.summary, t.policy)


@query
def message_composition_long(t: Tables) -> DataFrame:
    return msg.message_composition(t.long_message, t.long_summary, t.policy)


# --- streaming: each stream is run to its end and read back ------------------------------


def _message_stream(t: Tables) -> DataFrame:
    """The conversation table, a file or a folder of files, as a stream of messages in ten long threads."""
    # A stream takes a single file only by a pattern; one on file names would leave out those in a folder.
    source = t.spark.readStream.schema(t.raw("conversations").schema).parquet(f"{t.directory}/[c]onversations.parquet")
    return conversation_rows(source).select(
        (F.col("conv_id") % 10).cast("string").alias("thread_id"),
        (F.col("conv_id") * 1024 + F.col("turn")).alias("seq"),
        "message_id", "type", "content", "blocks", "tool_calls", "ts", "conv_id",
    )


def _run(t: Tables, stream: DataFrame, name: str, mode: str, keyed_state: bool = False) -> str:
    folder = shared_folder(t.spark, name)
    started = streams.write_batches(stream, f"{folder}/out", f"{folder}/checkpoint", mode, keyed_state=keyed_state)
    started.awaitTermination()
    return f"{folder}/out"


@query
def stream_thread_state(t: Tables) -> DataFrame:
    out = _run(t, streams.thread_state(_message_stream(t)), "thread-state", "update")
    return streams.latest_thread_state(t.spark, out)


def _in_batches(t: Tables, frames: list[DataFrame], files: int = 4) -> DataFrame:
    """Frames written one after the other and streamed about one per micro-batch."""
    folder = shared_folder(t.spark, "source")
    for frame in frames:
        frame.repartition(files).write.mode("append").parquet(folder)
    source = t.spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", files)
    return source.parquet(folder)


@query
def stream_thread_state_log(t: Tables) -> DataFrame:
    """Counters over a log with removals and returns, the later events first."""
    log = t.message_event.select("thread_id", "message_id", "seq", "op", "ts")
    step = F.col("seq") % 10
    stream = _in_batches(t, [log.filter(step == 7), log.filter(step == 0), log.filter(step == 5)])
    out = _run(t, streams.message_liveness(stream), "liveness", "update")
    return streams.live_thread_state(t.spark, out)


def _tick(t: Tables, like: DataFrame) -> DataFrame:
    """A row that moves the clock of a stream far on."""
    given = {"op": F.lit("tick"), "ts": F.expr("timestamp_ntz'2100-01-01'"), "seq": F.lit(0)}
    return t.spark.range(1).select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema]
    )


@query
def stream_compaction(t: Tables) -> DataFrame:
    stream = _message_stream(t).withColumn("op", F.lit("append"))
    ticks = _in_batches(t, [_tick(t, stream)], 1)
    folds = stream_compactor.compaction(stream.unionByName(ticks))
    out = _run(t, folds, "compaction", "append", keyed_state=True)
    return t.spark.read.parquet(out).select(
        "thread_id", "kind", "boundary_no", "at_message", "summarized_count"
    )


def _edited_long_log(t: Tables) -> DataFrame:
    """The log of the long threads with removals, returns, and overwrites some messages later."""
    p = F.col("position")
    steps = F.array_compact(F.array(
        F.lit(0), F.when(p % 7 == 5, 5), F.when((p % 7 == 5) & (F.col("thread_id").cast("bigint") % 2 == 0), 7),
        F.when(p % 7 == 2, 33), F.when(p % 11 == 1, 64),
    ))
    step = F.col("step")
    content = F.when(step == 33, F.concat("content", "content")).otherwise(F.col("content"))
    return t.long_message.withColumn("step", F.explode(steps)).select(
        "thread_id", (p * 10 + step).alias("seq"), F.when(step.isin(5, 64), "remove").otherwise("append").alias("op"),
        "message_id", "type", content.alias("content"), "tool_calls",
        F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' SECOND * (position * 10 + step)").alias("ts"),
    )


@query
def stream_compaction_log(t: Tables) -> DataFrame:
    """Folds while the edited log arrives in five micro-batches, each in no order and the first ones overlapping."""
    log = written(_edited_long_log(t), "edited-log")
    cuts, parts = [0, 120, 300, 900, 1 << 40], []
    for low, high in zip(cuts, cuts[1:]):
        parts.append(log.filter((F.col("seq") >= low) & (F.col("seq") < high) & (F.col("seq") % 70 != 30)
                                | (F.col("seq") % 70 == 30) & (F.col("seq") + 20 >= low) & (F.col("seq") + 20 < high)))
    stream = _in_batches(t, [*parts, _tick(t, log)])
    out = _run(t, stream_compactor.compaction(stream, SMALL, 60), "compaction-log", "append", keyed_state=True)
    return t.spark.read.parquet(out).select(
        "thread_id", "kind", "boundary_no", "at_message", "summarized_count", "seq"
    )


def _upserted(t: Tables, stream: DataFrame, name: str, keys: list[str], order: list[str], buckets: int) -> KeyedSnapshot:
    folder = shared_folder(t.spark, name)
    snapshot = KeyedSnapshot(f"{folder}/out", stream.schema, keys, order, buckets=buckets)
    upsert_batches(stream, snapshot, f"{folder}/checkpoint").awaitTermination()
    return snapshot


@query
def stream_notes(t: Tables) -> DataFrame:
    """Notes put and deleted by tool calls, read without a fold."""
    threads = t.raw("conversations").select((F.col("conv_id") % 10).cast("string").alias("thread_id"))
    profiles = threads.distinct().withColumn("profile_id", F.concat(F.lit("src"), "thread_id"))
    stream = streams.note_events(_message_stream(t).withColumnRenamed("seq", "position"), profiles)
    snapshot = _upserted(t, stream, "notes", ["profile_id", "note_id"], ["seq", "sub", "op"], 8)
    return snapshot.read(t.spark).drop("seq", "sub")


@query
def stream_message_snapshot(t: Tables) -> DataFrame:
    """The latest row of every message of a log, in three micro-batches with the later events first and one replayed."""
    log = t.message_event.select("thread_id", "message_id", "seq", "op", "type", "content", "ts")
    step = F.col("seq") % 10
    parts = [log.filter(step == 7), log.filter(step == 0), log.filter(step == 5)]
    snapshot = _upserted(t, _in_batches(t, parts), "messages", ["thread_id", "message_id"], ["seq"], 8)
    snapshot.merge(parts[2], 2)
    return snapshot.read(t.spark)


@query
def stream_dedup(t: Tables) -> DataFrame:
    """Each message arrives twice, in two batches by time, and is kept once."""
    rows = t.long_message.select("thread_id", "message_id", "ts")
    doubled = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    early = F.expr("ts < timestamp_ntz'2024-01-01 12:00:00'")
    stream = _in_batches(t, [doubled.filter(early), doubled.filter(~early)])
    out = _run(t, streams.distinct_messages(stream, "1 hour"), "dedup", "append")
    return t.spark.read.parquet(out).select("thread_id", "message_id")


@query
def stream_final_responses(t: Tables) -> DataFrame:
    out = _run(t, streams.final_responses(_message_stream(t)), "answers", "append")
    return t.spark.read.parquet(out).select("thread_id", "message_id", "response")


# --- SQL surface ---------------------------------------------------------------------------


@query
def readonly_sql(t: Tables) -> DataFrame:
    """The console's default statement: the ten latest sessions."""
    io.register_views({"session": t.session})
    return io.run_readonly_sql(
        t.spark, "SELECT * FROM session ORDER BY updated_at DESC, thread_id LIMIT 10;"
    )


# --- ordered scans with nearly every key cut into blocks --------------------------------------

SPLIT_ALL = SplitPolicy(sample_mod=2, min_cuts=1)
SCANS = [
    "entity_fold", "profile_fold", "delete_profiles", "fold_messages", "thread_state_asof", "thread_state_each_event", "regenerate", "notes_context", "cumulative_chars",
    "checkpoint_chain", "final_responses", "compaction_boundaries_small", "context_size_per_turn", "message_composition_long",
]


def _split(name: str) -> Query:
    return lambda spark, sf_dir: BUILDERS[name](Tables(spark, sf_dir, SPLIT_ALL))


REGISTRY |= {f"{name}_split": _split(name) for name in SCANS}
