import random
import time

import pytest
from conftest import SPLIT_ALL, rows
from pyspark.sql import functions as F

from chatterloom.operators import logs
from chatterloom.plans import edits
from chatterloom.schemas import TABLES

EVENT = "thread_id string, seq long, op string, message_id string, type string, content string"


def random_log(rng, thread, n):
    """A log whose sequence numbers have gaps."""
    seq, out = 0, []
    for _ in range(n):
        seq += rng.randint(1, 9)
        ident = f"m{rng.randint(0, max(2, n // 3))}"
        op = "remove" if rng.random() < 0.3 else "append"
        out.append((thread, seq, op, ident, None if op == "remove" else "human", None if op == "remove" else f"v{seq}"))
    return out


def reduce_list(log):
    """The reducer on a plain list: append, overwrite in place, remove."""
    state = []
    for _, _, op, ident, _, content in log:
        at = next((i for i, (k, _) in enumerate(state) if k == ident), None)
        if op == "remove":
            if at is not None:
                state.pop(at)
        elif at is None:
            state.append((ident, content))
        else:
            state[at] = (ident, content)
    return state


def test_fold_equals_list_reducer(spark, policy):
    rng = random.Random(7)
    threads = {f"t{i}": random_log(rng, f"t{i}", n) for i, n in enumerate([1, 3, 10, 20, 40, 80, 200])}
    events = [e for log in threads.values() for e in log]
    rng.shuffle(events)
    got = logs.fold_messages(spark.createDataFrame(events, EVENT), policy=policy)
    want = [
        (name, position, ident, content)
        for name, log in threads.items()
        for position, (ident, content) in enumerate(reduce_list(log))
    ]
    assert rows(got, "thread_id", "position", "message_id", "content") == sorted(want, key=repr)


def test_state_asof_is_the_fold_of_a_prefix(spark, policy):
    log = random_log(random.Random(3), "t", 60)
    cuts = {"early": log[10][1], "late": log[40][1], "before": 0}
    requests = spark.createDataFrame([(n, "t", s) for n, s in cuts.items()], "request_id string, thread_id string, seq long")
    got = edits.thread_state_asof(spark.createDataFrame(log, EVENT), requests, policy)
    want = [
        (name, position, ident)
        for name, upto in cuts.items()
        for position, (ident, _) in enumerate(reduce_list([e for e in log if e[1] <= upto]))
    ]
    assert rows(got, "request_id", "position", "message_id") == sorted(want, key=repr)


def test_state_asof_every_number_of_several_threads(spark, policy):
    rng = random.Random(12)
    logs_of = {name: random_log(rng, name, 25) for name in ("t", "u")}
    events = spark.createDataFrame([e for log in logs_of.values() for e in log], EVENT).withColumn("seq", F.col("seq") - 7)
    asked = [(f"{name}{s}", name, s - 7) for name, log in logs_of.items() for s in range(-1, max(e[1] for e in log) + 3)]
    requests = spark.createDataFrame([*asked, ("none", "unknown", 3)], "request_id string, thread_id string, seq long")
    got = edits.thread_state_asof(events, requests, policy)
    want = [
        (request, position, ident, content)
        for request, name, upto in asked
        for position, (ident, content) in enumerate(reduce_list([e for e in logs_of[name] if e[1] <= upto + 7]))
    ]
    assert rows(got, "request_id", "position", "message_id", "content") == sorted(want, key=repr)
    assert edits.thread_state_asof(events.limit(0), requests, policy).count() == 0


def test_stabbed_pairs_each_span_and_point_once(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), i, *sorted(rng.sample(range(70), 2))) for i in range(60)] + [("a", 99, 0, 64), ("a", 98, 5, 5)]
    points = [(rng.choice("ab"), i, rng.randrange(-2, 75)) for i in range(60)]
    got = edits.stabbed(
        spark.createDataFrame(spans, "k string, s long, lo long, hi long"), spark.createDataFrame(points, "k string, p long, at long"), key="k"
    )
    assert rows(got, "s", "p") == sorted(((s, p) for k, s, lo, hi in spans for x, p, at in points if k == x and lo <= at < hi), key=repr)


def test_regenerate_replaces_the_last_user_message(spark):
    log = [
        ("a", 0, "append", "a0", "human", "q1"), ("a", 1, "append", "a1", "ai", "r1"),
        ("a", 2, "append", "a2", "human", "q2"), ("a", 3, "append", "a3", "ai", "r2"),
        ("b", 0, "append", "b0", "ai", "hello"), ("c", 5, "append", "c0", "human", "only"),
    ]
    events = spark.createDataFrame(log, EVENT)
    edit = spark.createDataFrame(
        [("a", "a9", "q2 edited"), ("b", "b9", "first"), ("new", "n0", "fresh")], "thread_id string, message_id string, content string"
    )
    after = edits.regenerate(events, edit)
    assert after.count() == len(log) + 2 + 3, "the log only grows"
    assert rows(logs.fold_messages(after), "thread_id", "position", "message_id", "content") == [
        ("a", 0, "a0", "q1"), ("a", 1, "a1", "r1"), ("a", 2, "a9", "q2 edited"),
        ("b", 0, "b0", "hello"), ("b", 1, "b9", "first"), ("c", 0, "c0", "only"), ("new", 0, "n0", "fresh"),
    ]


ENTITY = "thread_id string, op string, title string, message_count int, ts timestamp_ntz, seq long"


def replay(events):
    """Entity log as a loop, one row at a time."""
    state = {}
    for key, op, title, count, ts, _ in events:
        if op == "create" and key not in state:
            state[key] = [title or "New Chat", ts, ts, 0]
        elif op == "delete":
            state.pop(key, None)
        elif key in state and op == "rename":
            state[key][0], state[key][2] = title.strip() or "Untitled", ts
        elif key in state and op == "touch":
            state[key][3], state[key][2] = count, ts
    return sorted(((k, *v) for k, v in state.items()), key=repr)


def test_entity_log_equals_replay(spark, policy):
    from datetime import datetime, timedelta

    rng, start, out = random.Random(11), datetime(2024, 1, 1), []
    for seq in range(400):
        op = rng.choice(["create", "rename", "rename", "touch", "touch", "delete"] if seq % 3 else ["create", "touch", "rename"])
        title = {"rename": rng.choice(["  ", f" t{seq} ", "x"]), "create": rng.choice([None, f"c{seq}"])}.get(op)
        key = "hot" if rng.random() < 0.5 else f"k{rng.randint(0, 12)}"
        out.append((key, op, title, seq if op == "touch" else None, start + timedelta(seconds=seq), seq))
    got = logs.fold_entity_log(spark.createDataFrame(out, ENTITY), "thread_id", policy=policy)
    assert rows(got, "thread_id", "title", "created_at", "updated_at", "message_count") == replay(out)


def test_upsert_is_last_write_wins_and_repeatable(spark):
    base = spark.createDataFrame([("a", 9, "base"), ("b", 9, "base")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("c", 1, "c")], "k string, at int, v string")
    once = logs.upsert_latest(base, new, ["k"], ["at"])
    assert rows(once) == [("a", 2, "two"), ("b", 9, "base"), ("c", 1, "c")]
    assert rows(logs.upsert_latest(once, new, ["k"], ["at"])) == rows(once)


def test_insert_if_absent_twice_equals_once(spark):
    base = spark.createDataFrame([("a", "old")], "k string, v string")
    new = spark.createDataFrame([("a", "new"), ("b", "2"), ("b", "1")], "k string, v string")
    once = logs.insert_if_absent(base, new, ["k"])
    assert rows(once) == [("a", "old"), ("b", "1")]
    assert rows(logs.insert_if_absent(once, new, ["k"])) == rows(once)


def test_bootstrap_is_repeatable(spark):
    stamp = F.expr("timestamp_ntz'2024-01-01'")
    profiles = spark.createDataFrame([("p", "Mine", None, None, "ann")], TABLES["profile"])
    accounts = spark.createDataFrame([("ann", None), (" Bob ", None), ("  ", None)], TABLES["user_account"])
    once = logs.profiles_for_accounts(logs.with_default_profile(profiles, stamp), accounts)
    assert sorted(r["username"] for r in once.collect()) == ["ann", "bob", "default_user"]
    assert rows(logs.profiles_for_accounts(logs.with_default_profile(once, stamp), accounts)) == rows(once)
    joined = logs.register_accounts(accounts.limit(1), accounts)
    assert rows(joined, "username") == [("ann",), ("bob",)]


def test_note_log(spark):
    events = spark.createDataFrame(
        [("p", "n1", "put", "a", "", None, 1), ("p", "n1", "put", "b", "", None, 2), ("p", "n2", "put", "c", "", None, 1),
         ("p", "n2", "delete", None, None, None, 3), ("p", "n3", "delete", None, None, None, 1)], TABLES["note_event"])
    live = logs.fold_notes(events)
    assert rows(live, "note_id", "text") == [("n1", "b")]
    assert rows(logs.dead_rows(events, live, "note_event")) == [("note_event", 1, 4)]


@pytest.mark.parametrize("split", [SPLIT_ALL])
def test_repeated_id_stays_in_place(spark, split):
    """One message rewritten many times is one row, at its first place."""
    log = [("t", 0, "append", "x", "human", "v0"), ("t", 1, "append", "y", "ai", "w")]
    log += [("t", s, "append", "x", "human", f"v{s}") for s in range(2, 200)]
    got = logs.fold_messages(spark.createDataFrame(log, EVENT), policy=split)
    assert rows(got, "position", "message_id", "content") == [(0, "x", "v199"), (1, "y", "w")]


def test_long_keys_fold_in_linear_time(spark):
    """One key of 250,000 events."""
    numbered = spark.range(250_000).select(F.lit("t").alias("thread_id"), F.col("id").alias("seq"))
    ops = F.when(F.col("seq") == 0, "create").when(F.col("seq") % 2 == 0, "touch").otherwise("rename")
    entity = numbered.select(
        "*", ops.alias("op"), F.lit("x").alias("title"), F.lit(1).alias("message_count"),
        F.expr("timestamp_ntz'2024-01-01'").alias("ts"),
    )
    messages = numbered.select("*", F.lit("append").alias("op"), F.lit("m").alias("message_id"), F.lit("x").alias("content"))
    for fold in (logs.fold_entity_log(entity, "thread_id"), logs.fold_messages(messages)):
        began = time.perf_counter()
        assert fold.count() == 1
        assert time.perf_counter() - began < 20


def test_profile_log(spark, policy):
    log = [("p", "rename", "early", None, 0), ("p", "create", None, "u", 1), ("p", "create", "twice", "v", 2), ("p", "touch", None, None, 3),
           ("q", "create", "named", "u", 1), ("q", "rename", " ", None, 2), ("r", "create", "a", "u", 1), ("r", "delete", None, None, 2),
           ("s", "create", "a", "u", 1), ("s", "delete", None, None, 2), ("s", "create", "b", "w", 3), ("x", "touch", None, None, 1)]
    df = spark.createDataFrame(log, "profile_id string, op string, name string, username string, seq long").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' DAY * seq")
    )
    got = logs.fold_profile_log(df, policy=policy).withColumn("at", F.dayofmonth("updated_at"))
    assert rows(got, "profile_id", "name", "username", "at") == [
        ("p", "New Profile", "u", 4), ("q", " ", "u", 3), ("s", "b", "w", 4),
    ]
