"""Folding append-only logs into current rows, and key-based upserts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom import config as C
from chatterloom.functions import text as X
from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, running
from chatterloom.session import written


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the greatest in ``order``.

    ``row_number() = 1`` becomes a per-partition group limit before the shuffle,
    so a key with many versions ships one row per map task.
    """
    newest = [F.desc(c) if isinstance(c, str) else c.desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert_latest(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Insert or overwrite by key; the last write wins and updates beat the base."""
    tagged = base.withColumn("_gen", F.lit(0)).unionByName(updates.withColumn("_gen", F.lit(1)))
    return newest_per_key(tagged, keys, ["_gen", *order]).drop("_gen")


def insert_if_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add rows whose key is new; existing rows stay untouched.

    Among new rows with one key the smallest by the remaining columns is kept,
    so the result does not depend on row order.
    """
    rest = [c for c in new.columns if c not in set(keys)]
    w = Window.partitionBy(*keys).orderBy(*rest) if rest else None
    if w is None:
        single = new.dropDuplicates(list(keys))
    else:
        single = new.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    fresh = single.join(base.select(*keys), list(keys), "left_anti").select(*new.columns)
    return base.unionByName(fresh, allowMissingColumns=True)


def profiles_for_accounts(profiles: DataFrame, accounts: DataFrame) -> DataFrame:
    """Every account gets at least one profile; the id is derived from the name."""
    wanted = accounts.select(
        X.normalize_username(F.col("username")).alias("username"), "created_at"
    ).filter("username IS NOT NULL")
    missing = wanted.join(profiles.select("username"), "username", "left_anti")
    new = missing.groupBy("username").agg(F.min("created_at").alias("created_at")).select(
        F.sha2(F.concat(F.lit("profile:"), "username"), 256).alias("profile_id"),
        F.lit(C.DEFAULT_PROFILE_NAME).alias("name"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        "username",
    )
    return profiles.unionByName(new)


def with_default_profile(profiles: DataFrame, stamp: Column) -> DataFrame:
    """Seed the default profile once; running it again changes nothing."""
    seed = profiles.sparkSession.range(1).select(
        F.lit(C.DEFAULT_PROFILE_ID).alias("profile_id"),
        F.lit(C.DEFAULT_PROFILE_NAME).alias("name"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        F.lit(C.DEFAULT_USERNAME).alias("username"),
    )
    return insert_if_absent(profiles, seed, ["profile_id"])


def register_accounts(accounts: DataFrame, requests: DataFrame) -> DataFrame:
    """Add accounts for valid names; blank names and taken names are ignored."""
    valid = requests.withColumn("username", X.normalize_username(F.col("username")))
    return insert_if_absent(accounts, valid.filter("username IS NOT NULL"), ["username"])


def _since_last_delete(events: DataFrame, key: str, policy: SplitPolicy) -> DataFrame:
    gone = (F.col("op") == "delete").cast("int")
    return running(events, [key], ["seq"], after={"_dels": gone}, policy=policy).filter("_dels = 0")


def fold_entity_log(
    events: DataFrame, key: str, default_title: str = C.NEW_CHAT_TITLE, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Current rows of a create / rename / touch / delete log.

    A patch on a missing key does nothing, and so does a second create. Rows at
    or before the last delete are dropped by a sum over what follows; after that
    the latest patch is valid exactly when it comes after the create, so one
    aggregate settles every column.
    """
    op = F.col("op")
    alive = _since_last_delete(events, key, policy)
    created, renamed, touched = op == "create", op == "rename", op == "touch"
    patched = renamed | touched
    seq = F.col("seq")
    folded = alive.groupBy(key).agg(
        F.min(F.when(created, seq)).alias("_born"),
        F.min_by(F.struct("title", "ts"), F.when(created, seq)).alias("_create"),
        F.max(F.when(renamed, seq)).alias("_renamed"),
        F.max_by("title", F.when(renamed, seq)).alias("_title"),
        F.max(F.when(touched, seq)).alias("_touched"),
        F.max_by("message_count", F.when(touched, seq)).alias("_count"),
        F.max(F.when(patched, seq)).alias("_patched"),
        F.max_by("ts", F.when(patched, seq)).alias("_patch_ts"),
    )
    first_title = F.coalesce(F.col("_create.title"), F.lit(default_title))
    return folded.filter("_born IS NOT NULL").select(
        key,
        F.when(F.col("_renamed") > F.col("_born"), X.cleaned_title(F.col("_title")))
        .otherwise(first_title)
        .alias("title"),
        F.col("_create.ts").alias("created_at"),
        F.when(F.col("_patched") > F.col("_born"), F.col("_patch_ts"))
        .otherwise(F.col("_create.ts"))
        .alias("updated_at"),
        F.when(F.col("_touched") > F.col("_born"), F.col("_count"))
        .otherwise(F.lit(0))
        .alias("message_count"),
    )


def fold_profile_log(
    events: DataFrame, default_name: str = C.NEW_PROFILE_NAME, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Current profiles of a create / rename / touch / delete log.

    ``events(profile_id, op, name, username, ts, seq)``. A create without a name gets
    the default; a rename stores its name as given; rename and touch move
    ``updated_at``. Patches on a missing profile and second creates do nothing. A
    delete in the log takes effect: refusals are settled before it is written.
    """
    op, seq = F.col("op"), F.col("seq")
    patched = op.isin("rename", "touch")
    folded = _since_last_delete(events, "profile_id", policy).groupBy("profile_id").agg(
        F.min(F.when(op == "create", seq)).alias("_born"),
        F.min_by(F.struct("name", "username", "ts"), F.when(op == "create", seq)).alias("_create"),
        F.max(F.when(op == "rename", F.struct("seq", "name"))).alias("_rename"),
        F.max(F.when(patched, F.struct("seq", "ts"))).alias("_patch"),
    )
    first_name = F.coalesce(F.col("_create.name"), F.lit(default_name))
    return folded.filter("_born IS NOT NULL").select(
        "profile_id",
        F.when(F.col("_rename.seq") > F.col("_born"), F.col("_rename.name")).otherwise(first_name).alias("name"),
        F.col("_create.ts").alias("created_at"),
        F.when(F.col("_patch.seq") > F.col("_born"), F.col("_patch.ts")).otherwise(F.col("_create.ts")).alias("updated_at"),
        F.col("_create.username").alias("username"),
    )


def fold_messages(
    events: DataFrame, keys: Sequence[str] = ("thread_id",), policy: SplitPolicy = DEFAULT_SPLIT, keep_seq: bool = False
) -> DataFrame:
    """Current message list of every thread, ``position`` 0-based.

    Events are ordered by ``seq`` and, where the log has it, by ``sub`` (missing: 0),
    the place among events that share a ``seq``. A new id appends, a known id
    overwrites in place, ``remove`` drops the id, and an id appended after its removal
    goes to the end. A maximum per id over numbers decides what survives and one narrow
    scan where, with the survivors written in between; message bodies are
    shuffled once, in the final join on the sequence number that holds them. With
    ``keep_seq`` the number that placed a message comes along as ``seq``.
    """
    keys, order = list(keys), ["seq", "sub"]
    given = F.coalesce("sub", F.lit(0)) if "sub" in events.columns else F.lit(0)
    numbered = events.withColumn("sub", given.cast("bigint"))
    ids = numbered.select(*keys, "message_id", F.struct(*order).alias("_at"), (F.col("op") == "remove").alias("_rm"))
    # The last removal of an id decides: a maximum, so an id with very many events is no large group.
    cut = ids.filter("_rm").groupBy(*keys, "message_id").agg(F.max("_at").alias("_cut"))
    cut = cut.withColumnsRenamed({c: f"_cut_{c}" for c in [*keys, "message_id"]})
    same = reduce(and_, [ids[c].eqNullSafe(cut[f"_cut_{c}"]) for c in [*keys, "message_id"]])
    kept = (
        ids.filter("NOT _rm").join(cut, same, "left").filter("_cut IS NULL OR _at > _cut")
        .groupBy(*keys, "message_id")
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
        .select(*keys, "message_id", "_last.*", F.col("_first.seq").alias("_seq"), F.col("_first.sub").alias("_sub"))
    )
    placed = running(
        written(kept, "kept-ids"), keys, ["_seq", "_sub"], {"position": F.lit(1)}, policy=policy
    ).withColumn("position", F.col("position") - 1)
    bodies = numbered.filter(F.col("op") == "append")
    rest = [c for c in events.columns if c not in {*keys, "message_id", "seq", "sub", "op"}]
    number = [F.col("_seq").alias("seq")] if keep_seq else []
    return bodies.join(placed, [*keys, "message_id", *order]).select(*keys, "position", "message_id", *number, *rest)


def append_messages(log: DataFrame, new: DataFrame) -> DataFrame:
    """Append to the log; the fold decides what an append means."""
    return log.unionByName(new, allowMissingColumns=True)


def fold_notes(events: DataFrame) -> DataFrame:
    """Current notes of a put / delete log; the last event of a note decides."""
    order = ["seq", "sub", "op"] if "sub" in events.columns else ["seq", "op"]
    latest = newest_per_key(events, ["profile_id", "note_id"], order)
    return latest.filter(F.col("op") == "put").drop("op", "seq", "sub")


def dead_rows(log_rows: DataFrame, live_rows: DataFrame, name: str) -> DataFrame:
    """Live and superseded rows of one log, the candidates for compaction."""
    sides = log_rows.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("log")).unionByName(
        live_rows.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("live"))
    )
    live = F.sum(F.when(F.col("side") == "live", F.col("n")))
    total = F.sum(F.when(F.col("side") == "log", F.col("n")))
    return sides.agg(live.alias("live_rows"), (total - live).alias("dead_rows")).select(
        F.lit(name).alias("table_name"), "live_rows", "dead_rows"
    )
