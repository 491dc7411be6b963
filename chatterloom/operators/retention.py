"""Deletes with their cascades, and integrity audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterloom.operators.blocks import DEFAULT_SPLIT, SplitPolicy, running
from chatterloom.schemas import NOT_NULL, PRIMARY_KEYS
from chatterloom.session import written


def cascade_delete(
    tables: Mapping[str, DataFrame], thread_ids: DataFrame, key: str = "thread_id"
) -> dict[str, DataFrame]:
    """Remove threads from every table that carries the thread key.

    The ids are written first: they are worked out once for all tables, and their
    known size lets a short list be broadcast, so the tables are not shuffled.
    """
    gone = written(thread_ids.select(key).distinct(), "deleted-ids")
    return {
        name: df.join(gone, key, "left_anti").select(df.columns) for name, df in tables.items()
    }


def decide_profile_deletes(
    profiles: DataFrame, requests: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT
) -> DataFrame:
    """Outcome of each requested profile: ``deleted``, ``rejected`` or ``ignored``.

    Requests are taken in time order, one per profile and user. A user keeps at
    least one profile, so only the first ``profiles - 1`` owned requests pass.
    Requests for a profile of somebody else (or none) are ignored.
    """
    first = requests.groupBy("profile_id", "username").agg(F.min("ts").alias("ts"))
    owned = first.join(profiles.select("profile_id", "username"), ["profile_id", "username"], "left_semi")
    ignored = first.join(
        profiles.select("profile_id", "username"), ["profile_id", "username"], "left_anti"
    )
    held = profiles.groupBy("username").agg(F.count(F.lit(1)).alias("_held"))
    ranked = running(written(owned, "owned-requests"), ["username"], ["ts", "profile_id"], {"_rank": F.lit(1)}, policy=policy)
    decided = ranked.join(held, "username").select(
        "profile_id",
        "username",
        "ts",
        F.when(F.col("_rank") <= F.col("_held") - 1, "deleted").otherwise("rejected").alias("outcome"),
    )
    return decided.unionByName(
        ignored.select("profile_id", "username", "ts", F.lit("ignored").alias("outcome"))
    )


def delete_profiles(
    profiles: DataFrame, notes: DataFrame, requests: DataFrame, policy: SplitPolicy = DEFAULT_SPLIT
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(profiles, notes, decisions)`` after the requests, decided once."""
    decisions = written(decide_profile_deletes(profiles, requests, policy), "profile-decisions")
    gone = decisions.filter(F.col("outcome") == "deleted").select("profile_id")
    return (
        profiles.join(gone, "profile_id", "left_anti").select(profiles.columns),
        notes.join(gone, "profile_id", "left_anti").select(notes.columns),
        decisions,
    )


def delete_notes(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Remove by (profile, note id); unknown ids are fine."""
    return notes.join(
        requests.select("profile_id", "note_id"), ["profile_id", "note_id"], "left_anti"
    ).select(notes.columns)


def _row_id(columns: Sequence[str]) -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in columns])


def duplicate_keys(name: str, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return found.select(
        F.lit(name).alias("table_name"), F.lit("primary_key").alias("violation"), _row_id(keys).alias("row_key")
    )


def missing_values(name: str, df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    holes = F.filter(
        F.array(*[F.when(F.col(c).isNull(), F.lit(f"not_null:{c}")) for c in required]),
        lambda v: v.isNotNull(),
    )
    return df.select(
        F.lit(name).alias("table_name"), F.explode(holes).alias("violation"), _row_id(keys).alias("row_key")
    )


def orphans(name: str, df: DataFrame, keys: Sequence[str], parent: DataFrame, link: str) -> DataFrame:
    return df.join(parent.select(link), link, "left_anti").select(
        F.lit(name).alias("table_name"), F.lit(f"foreign_key:{link}").alias("violation"), _row_id(keys).alias("row_key")
    )


def broken_links(chain: DataFrame) -> DataFrame:
    """Chain rows (from ``checkpoint_chain``) whose parent is not the previous id."""
    return chain.filter(~F.col("parent_ok")).select(
        F.lit("checkpoint").alias("table_name"),
        F.lit("parent_chain").alias("violation"),
        _row_id(["thread_id", "checkpoint_id"]).alias("row_key"),
    )


def _facts(name: str, df: DataFrame, links: Sequence[tuple[str, str, str]]) -> DataFrame:
    """What each row says about the rules: ``rule, value, claims, grants``, out of one scan of its table."""
    claim = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.alias("value"), F.lit(1).alias("claims"), F.lit(0).alias("grants"))
    grant = lambda rule, value: F.struct(F.lit(rule).alias("rule"), value.alias("value"), F.lit(0).alias("claims"), F.lit(1).alias("grants"))
    said = [claim(f"primary_key:{name}", _row_id(PRIMARY_KEYS[name]))]
    said += [F.when(F.col(c).isNull(), claim(f"not_null:{name}", F.lit(c))) for c in NOT_NULL.get(name, ())]
    for child, parent, link in links:
        value, rule = F.col(link).cast("string"), f"foreign_key:{child}:{link}"
        said += [claim(rule, value)] if child == name else []
        said += [F.when(value.isNotNull(), grant(rule, value))] if parent == name else []
    if name == "checkpoint" and "parent_checkpoint_id" in df.columns:
        spot = lambda c: F.concat(F.length("thread_id"), F.lit(":"), "thread_id", F.coalesce(F.concat(F.lit("/"), c), F.lit("")))
        said += [claim("parent_chain", spot("parent_checkpoint_id")), grant("parent_chain", spot("checkpoint_id"))]
        said += [F.when(F.col("parent_checkpoint_id").isNull(), grant("parent_chain", spot("parent_checkpoint_id")))]
        said += [F.when(F.col("parent_checkpoint_id") >= F.col("checkpoint_id"), claim("chain_order", F.lit("")))]
    return df.select(F.inline(F.array_compact(F.array(*said))))


def fired_rules(tables: Mapping[str, DataFrame], links: Sequence[tuple[str, str, str]]) -> set[str]:
    """Rules that some row breaks, from one scan of every table in one job.

    A key, or a parent in a chain, may be claimed once; a link needs a grant by its
    parent. A chain is right if every checkpoint but the first names a smaller one of
    its thread as parent and no two name the same: then each names the one before it.
    """
    facts = reduce(DataFrame.unionByName, [_facts(n, df, links) for n, df in tables.items()])
    met = facts.groupBy("rule", "value").agg(F.sum("claims").alias("claims"), F.max("grants").alias("grants"))
    kind = F.substring_index("rule", ":", 1)
    once = kind.isin("primary_key", "parent_chain") & (F.col("claims") > 1)
    granted = kind.isin("foreign_key", "parent_chain") & (F.col("claims") > 0) & (F.col("grants") == 0)
    broken = met.filter(once | granted | kind.isin("not_null", "chain_order"))
    return {r.rule for r in broken.select("rule").distinct().collect()}  # a few per table


def integrity_audit(
    tables: Mapping[str, DataFrame],
    foreign_keys: Sequence[tuple[str, str, str]] = (("summary_context", "session", "thread_id"),),
    policy: SplitPolicy = DEFAULT_SPLIT,
) -> DataFrame:
    """One row per broken key, link or required value over the given tables.

    One job reads every table once and tells which rules are broken; only those are
    looked into row by row.
    """
    from chatterloom.operators.reports import checkpoint_chain

    links = [x for x in foreign_keys if x[0] in tables and x[1] in tables]
    fired = fired_rules(tables, links)
    parts: list[DataFrame] = []
    for name, df in tables.items():
        keys = PRIMARY_KEYS[name]
        if f"primary_key:{name}" in fired:
            parts.append(duplicate_keys(name, df, keys))
        if f"not_null:{name}" in fired:
            parts.append(missing_values(name, df, keys, NOT_NULL[name]))
    for child, parent, link in links:
        if f"foreign_key:{child}:{link}" in fired:
            parts.append(orphans(child, tables[child], PRIMARY_KEYS[child], tables[parent], link))
    if fired & {"parent_chain", "chain_order"} or "primary_key:checkpoint" in fired and "parent_checkpoint_id" in tables["checkpoint"].columns:
        parts.append(broken_links(checkpoint_chain(tables["checkpoint"], policy)))
    if not parts:
        none = next(iter(tables.values())).sparkSession.createDataFrame([], "table_name string, violation string, row_key string")
        return none
    return reduce(DataFrame.unionByName, parts)
