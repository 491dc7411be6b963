import random
from datetime import datetime, timedelta

import pytest
from conftest import SPLIT_ALL, make_messages, rows
from pyspark.sql import functions as F

from chatterloom import Wording
from chatterloom.operators import messages as M, reports, retention, scope
from chatterloom.plans import context, memory
from chatterloom.schemas import TABLES

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def profiles(spark, data):
    return spark.createDataFrame([(p, p.upper(), T0, at(u), user) for p, user, u in data], TABLES["profile"])


def notes(spark, data):
    return spark.createDataFrame([(p, n, t, c, None) for p, n, t, c in data], TABLES["note"])


def test_last_profile_is_kept(spark, policy):
    held = profiles(spark, [("a1", "ann", 0), ("b1", "bob", 0), ("b2", "bob", 0), ("c1", "cy", 0), ("c2", "cy", 0), ("c3", "cy", 0)])
    asked = spark.createDataFrame(
        [("a1", "ann", at(1)), ("b2", "bob", at(2)), ("b1", "bob", at(3)), ("b2", "bob", at(4)),
         ("c1", "bob", at(0)), ("c3", "cy", at(9)), ("c1", "cy", at(8)), ("zz", "cy", at(1))],
        "profile_id string, username string, ts timestamp_ntz",
    )
    kept, left, decisions = retention.delete_profiles(held, notes(spark, [("b2", "n", "t", ""), ("b1", "n", "t", "")]), asked, policy)
    assert rows(decisions, "profile_id", "username", "outcome") == [
        ("a1", "ann", "rejected"), ("b1", "bob", "rejected"), ("b2", "bob", "deleted"), ("c1", "bob", "ignored"),
        ("c1", "cy", "deleted"), ("c3", "cy", "deleted"), ("zz", "cy", "ignored"),
    ]
    assert [r[0] for r in rows(kept, "profile_id")] == ["a1", "b1", "c2"]
    assert rows(left, "profile_id") == [("b1",)]


def test_cascade_then_audit_is_clean(spark):
    session = spark.createDataFrame([("t1", "a", T0, T0, 1, "u"), ("t2", "b", T0, T0, 1, "u")], TABLES["session"])
    summary = spark.createDataFrame([("t1", "s", 1, T0), ("t2", "s", 1, T0)], TABLES["summary_context"])
    chain = spark.createDataFrame([("t1", "c1", None, T0), ("t2", "c1", None, T0), ("t2", "c2", "c1", T0)], TABLES["checkpoint"])
    gone = spark.createDataFrame([("t1",), ("t1",)], "thread_id string")
    tables = {"session": session, "summary_context": summary, "checkpoint": chain}
    left = retention.cascade_delete(tables, gone)
    assert all(df.filter("thread_id = 't1'").count() == 0 and df.count() > 0 for df in left.values())
    assert retention.integrity_audit(left).count() == 0
    half = retention.integrity_audit({**left, "summary_context": summary})
    assert rows(half) == [("summary_context", "foreign_key:thread_id", "t1")]


def test_audit_finds_planted_faults(spark, policy):
    session = spark.createDataFrame([("t", None, T0, T0, None, "u"), ("t", "b", T0, T0, 1, "u")], TABLES["session"])
    chain = spark.createDataFrame(
        [("t", "c1", None, T0), ("t", "c2", None, T0), ("t", "c3", "c2", T0), ("t", "c4", "c2", T0), ("t", "c5", "c4", T0)],
        TABLES["checkpoint"],
    )
    got = rows(retention.integrity_audit({"session": session, "checkpoint": chain}, policy=policy))
    assert got == [
        ("checkpoint", "parent_chain", "t/c2"), ("checkpoint", "parent_chain", "t/c4"),
        ("session", "not_null:message_count", "t"), ("session", "not_null:title", "t"), ("session", "primary_key", "t"),
    ]


@pytest.mark.parametrize("seed", range(12))
def test_audit_in_one_pass_fires_exactly_for_broken_chains(spark, seed):
    rng, data = random.Random(seed), []
    for thread in ("a", "b/1", "b"):
        ids = [f"c{i}" for i in sorted(rng.sample(range(10, 99), rng.randrange(1, 6)))]
        parents = [None, *ids[:-1]]
        if rng.random() < 0.4:
            parents[rng.randrange(len(parents))] = rng.choice([None, "c00", "c99", *ids])
        data += [(thread, c, p, T0) for c, p in zip(ids, parents)]
    chain = spark.createDataFrame(data, TABLES["checkpoint"])
    broken = reports.checkpoint_chain(chain).filter("NOT parent_ok").count()
    fired = retention.fired_rules({"checkpoint": chain}, [])
    assert bool(fired & {"parent_chain", "chain_order"}) == bool(broken)
    assert retention.integrity_audit({"checkpoint": chain}).count() == broken


def test_audit_of_clean_tables_is_one_job_and_one_scan_each(spark, tmp_path):
    session = spark.createDataFrame([(f"t{i}", "x", T0, T0, 1, "u") for i in range(50)], TABLES["session"])
    chain = spark.createDataFrame([("t1", f"c{i}", f"c{i - 1}" if i > 10 else None, T0) for i in range(10, 60)], TABLES["checkpoint"])
    for name, df in (("session", session), ("checkpoint", chain)):
        df.write.parquet(f"{tmp_path}/{name}")
    tables = {n: spark.read.schema(TABLES[n]).parquet(f"{tmp_path}/{n}") for n in ("session", "checkpoint")}
    links = [("checkpoint", "session", "thread_id")]
    facts = retention._facts("session", tables["session"], links).unionByName(retention._facts("checkpoint", tables["checkpoint"], links))
    assert facts._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    assert retention.fired_rules(tables, links) == set()
    clean = retention.integrity_audit(tables, links)
    assert clean.count() == 0 and clean.columns == ["table_name", "violation", "row_key"]


def test_chain_over_many_steps(spark, policy):
    ids = [f"c{i:04d}" for i in range(300)]
    chain = spark.createDataFrame([("t", c, p, T0) for c, p in zip(ids, [None, *ids])], TABLES["checkpoint"])
    got = reports.checkpoint_chain(chain, policy)
    assert got.filter("not parent_ok").count() == 0
    assert [r[0] for r in rows(got.select(F.lpad("step", 4, "0").alias("s")))] == [f"{i:04d}" for i in range(300)]


def test_scoping_and_orphans(spark):
    session = spark.createDataFrame([("t1", None, T0, T0, 1, "ann"), ("t2", "two", T0, T0, 1, "bob")], TABLES["session"])
    chain = spark.createDataFrame([("t1", "a", None, T0), ("t1", "b", "a", T0), ("t2", "a", None, T0), ("orphan", "a", None, T0)], TABLES["checkpoint"])
    count = lambda user: reports.scoped_checkpoint_count(chain, session, user).first()[0]
    assert (count(None), count("ann"), count("nobody")) == (3, 2, 0)
    top = [tuple(r) for r in reports.top_threads(chain, session, k=2).collect()]
    assert top == [("t1", "t1", "ann", 2), ("orphan", "orphan", None, 1)]
    assert [r["thread_id"] for r in reports.top_threads(chain, session, "bob").collect()] == ["t2"]
    names = rows(scope.titles_for(spark.createDataFrame([("t2",), ("x",)], "thread_id string"), session))
    assert names == [("t2", "two"), ("x", "New Chat")]


def test_overrun_and_clamp(spark):
    m = make_messages(spark, [("human", "a"), ("ai", "b")])
    s = spark.createDataFrame([("t", "s", 5, T0)], TABLES["summary_context"])
    chain = spark.createDataFrame([], TABLES["checkpoint"])
    assert rows(reports.thread_overview(m, s, chain)) == [("t", 2, -3, 5, 0, True)]
    assert rows(reports.thread_overview(m, s, chain, clamp=True)) == [("t", 2, 0, 5, 0, True)]


def test_mean_notes_rounds_half_to_even(spark):
    held = profiles(spark, [(f"p{i}", "u", 0) for i in range(20)])
    # 45 notes over 20 profiles: 2.25 becomes 2.2
    data = notes(spark, [(f"p{i % 3}", f"n{i}", "t", "") for i in range(45)])
    assert rows(reports.note_metrics(held, data)) == [(20, 45, 2.2)]
    assert rows(reports.note_metrics(held.limit(0), data)) == [(0, 0, 0.0)]
    assert reports.profile_note_counts(held, data).filter("note_count = 0").count() == 17


def test_next_active_session_after_delete(spark):
    s = spark.createDataFrame([("t1", "a", T0, at(1), 1, "u"), ("t2", "b", T0, at(2), 1, "u"), ("t3", "c", T0, at(2), 1, "u")], TABLES["session"])
    first = reports.active_session(s)
    assert rows(first, "thread_id") == [("t2",)]
    left = retention.cascade_delete({"session": s}, first)["session"]
    assert rows(reports.active_session(left), "thread_id") == [("t3",)]


def test_composition_with_a_long_thread(spark, policy):
    m = make_messages(spark, [("human" if i % 3 else "tool", "x" * (i % 7)) for i in range(200)])
    s = spark.createDataFrame([("t", "s", 10, T0)], TABLES["summary_context"])
    got = M.message_composition(m, s, policy).orderBy("turn_index").collect()
    total = 0
    for i, r in enumerate(got):
        total += i % 7
        assert (r["turn_index"], r["length"], r["cumulative_chars"]) == (i + 1, i % 7, total)
        assert r["is_summarized"] == (i < 10) and r["boundary"] == 10.5
        assert r["role"] == ("user" if i % 3 else "assistant")


def test_answers_per_turn(spark, policy):
    call = [("c", "add_memory", {"note": "n"})]
    items = [
        ("ai", "greeting"), ("human", "q1"), ("ai", "", call), ("tool", "ok"), ("ai", "a1"), ("human", "q2"), ("ai", "x", call),
        ("human", "q3"), ("ai", " \n"), ("human", "q4"), ("ai", "first"), ("ai", "second"),
    ]
    got = rows(M.final_responses(make_messages(spark, items), policy=policy), "turn_no", "response")
    assert got == [(1, "a1"), (2, Wording().no_answer), (3, Wording().no_answer), (4, "second")]


def test_titles_and_last_user_message(spark):
    none = make_messages(spark, [("ai", "hi"), ("tool", "x")], "none")
    two = make_messages(spark, [("system", "s"), ("human", "  first\n"), ("human", " ")], "two")
    both = none.unionByName(two)
    assert rows(M.auto_title(both)) == [("none", "New Chat"), ("two", "first")]
    noted = make_messages(spark, [("human", "hi\n\n[Attached image - vision analysis: a cat]")], "noted")
    assert rows(M.auto_title(noted)) == [("noted", "hi")]
    assert rows(M.last_human(both), "thread_id", "position", "text") == [("two", 2, " ")]
    assert rows(M.role_counts(both)) == [("none", "assistant", 2), ("two", "assistant", 1), ("two", "user", 2)]


def test_images_become_text(spark):
    items = [
        ("human", None, None, [("text", "see", None), ("image_url", None, "u")]), ("human", None, None, [("image_url", None, "u")]),
        ("human", "plain"),
    ]
    m = make_messages(spark, items)
    d = spark.createDataFrame([("t-0", "cat")], "message_id string, description string")
    got = M.describe_images(m, d)
    assert got.filter("blocks is not null").count() == 0
    assert [r["content"] for r in got.orderBy("position").collect()] == [
        "see\n\n[Attached image - vision analysis: cat]", "[image]", "plain",
    ]


def test_truncate(spark):
    m = make_messages(spark, [("human", str(i)) for i in range(10)], "a").unionByName(make_messages(spark, [("ai", "x")], "b"))
    edit = spark.createDataFrame([("a", 4)], "thread_id string, edit_position long")
    kept, removed = M.truncate_from(m, edit)
    assert rows(kept, "thread_id", "position") == [*[("a", i) for i in range(4)], ("b", 0)]
    assert [r[0] for r in rows(removed, "position")] == list(range(4, 10))


def test_notes_text_in_pages(spark, policy):
    data = notes(spark, [("p", f"n{i:03d}", f"text {i}", f"2024-{i // 3:03d}") for i in range(100)] + [("q", "n", None, "")])
    whole = {r["profile_id"]: r["text"] for r in context.notes_context(data, policy=policy).collect()}
    lines = [f"- [id: n{i:03d}] text {i}" for i in range(100)]
    assert whole["p"] == "\n".join([Wording().notes_header, *lines])
    assert whole["q"] == Wording().notes_header + "\n- [id: n] "
    pages = context.notes_context(data.filter("profile_id = 'p'"), page_bytes=150, policy=policy).orderBy("page").collect()
    assert [p["page"] for p in pages] == list(range(len(pages))) and len(pages) > 10 and "\n".join(p["text"] for p in pages) == whole["p"]
    plain = context.notes_context(data, with_ids=False).filter("profile_id = 'p'").first()["text"]
    assert plain.split("\n")[1] == "- text 0"


def test_context_rows(spark):
    w = Wording()
    m = make_messages(spark, [("human", str(i)) for i in range(5)], "both")
    for name in ("summary", "notes", "bare", "idle"):
        m = m.unionByName(make_messages(spark, [("human", "x")], name))
    s = spark.createDataFrame([("both", "sum", 3, T0), ("summary", "sum", 0, T0), ("bare", "", 0, T0)], TABLES["summary_context"])
    active = spark.createDataFrame([("both", "p"), ("summary", "none"), ("notes", "p"), ("bare", "none")], "thread_id string, profile_id string")
    n = notes(spark, [("p", f"n{i}", "t", str(i)) for i in range(3)])
    got = rows(context.assemble_context_requested(m, s, n, active), "thread_id", "position", "part", "content")
    listed = w.notes_header + "".join(f"\n- [id: n{i}] t" for i in range(3))
    wrapped = w.summary_lead + "sum" + w.summary_tail
    want = [
        ("both", -1, 0, listed + w.section_rule + wrapped), ("both", 3, 0, "3"), ("both", 4, 0, "4"),
        ("summary", -1, 0, wrapped), ("summary", 0, 0, "x"), ("notes", -1, 0, listed), ("notes", 0, 0, "x"), ("bare", 0, 0, "x"),
    ]
    assert got == sorted(want, key=repr)
    once = rows(context.assemble_context(m, s, n, active), "profile_id", "thread_id", "position", "content")
    want = [("p", None, -2, listed), ("p", "both", -1, wrapped), ("p", "notes", -1, None), ("none", "summary", -1, wrapped),
            ("none", "bare", -1, None), *[(None, *row) for row in
            [("both", 3, "3"), ("both", 4, "4"), ("summary", 0, "x"), ("notes", 0, "x"), ("bare", 0, "x")]]]
    assert once == sorted(want, key=repr)
    paged = context.assemble_context_requested(m, s, n, active, page_bytes=26, policy=SPLIT_ALL).filter("thread_id = 'both' and position = -1")
    parts = [r["content"] for r in paged.orderBy("part").collect()]
    assert len(parts) == 2 and "\n".join(parts) == listed + w.section_rule + wrapped


def test_tool_calls(spark):
    calls = [("c1", "add_memory", {"note": "likes tea"}), ("c2", "forget_memory", {"note_id": "old"}), ("c3", "web", {}), ("c4", "add_memory", {})]
    m = make_messages(spark, [("human", "hi"), ("ai", "", calls)]).withColumn("ts", F.expr("timestamp_ntz'2024-01-01'"))
    owner = spark.createDataFrame([("t", "p")], "thread_id string, profile_id string")
    effects = memory.tool_call_effects(m, owner)
    assert rows(effects, "tool_call_id", "action") == [("c1", "put"), ("c2", "delete"), ("c3", "unknown"), ("c4", "failed")]
    events, touches, answers = memory.dispatch_tool_calls(m, owner)
    assert rows(events, "op", "text") == [("delete", None), ("put", "likes tea")]
    assert rows(touches, "profile_id") == [("p",)] and answers.count() == 4
    assert "Unknown tool: web" in {r["content"] for r in answers.collect()}
    held = profiles(spark, [("p", "u", -5), ("q", "u", -5)])
    moved = {r["profile_id"]: r["updated_at"] for r in memory.touch_profiles(held, touches).collect()}
    assert moved == {"p": T0, "q": at(-5)}


def test_bullets(spark):
    texts = [
        ("1", "t", "p", "- one\n  - two  \n-three\n- \ntext\n-  four"), ("2", "t", "p", " NONE \n"), ("3", "t", "p", "none of it"),
        ("4", "t", "q", " "), ("5", "blank", "p", "- lost"), ("6", "absent", "p", "- lost"),
    ]
    responses = spark.createDataFrame(texts, "response_id string, thread_id string, profile_id string, text string")
    humans = spark.createDataFrame([("t", "hi"), ("blank", "")], "thread_id string, text string")
    assert rows(memory.extract_notes(responses, humans), "response_id", "line_no", "text") == [("1", 0, "one"), ("1", 1, "two"), ("1", 5, "four")]
    assert rows(memory.extraction_touches(responses, humans)) == [("p",)]


def test_notes_from_a_text_function(spark):
    m = make_messages(spark, [("human", "I like tea"), ("ai", "noted"), ("human", "bye"), ("ai", "see you")])
    empty = make_messages(spark, [("human", ""), ("ai", "a")], "empty")
    silent = make_messages(spark, [("human", "hello")], "silent")
    owner = spark.createDataFrame([("t", "p"), ("empty", "p"), ("silent", "p")], "thread_id string, profile_id string")
    whole = m.unionByName(empty).unionByName(silent)
    prompts = memory.extraction_prompts(whole, owner)
    assert rows(prompts, "thread_id") == [("t",)] and "USER: bye\nANSWER: see you" in prompts.first()["prompt"]
    responses = memory.ask_for_notes(prompts, lambda p: "- said " + p.str.extract(r"USER: (\w+)")[0])
    assert rows(memory.extract_notes(responses, M.last_human(whole)), "thread_id", "text") == [("t", "said bye")]
