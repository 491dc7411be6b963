import random

import pandas as pd
import pytest
from conftest import SPLIT_ALL, make_messages, make_threads, rows
from pyspark.sql import functions as F

from chatterloom import CompactionConfig, Wording
from chatterloom.config import NON_TEXT
from chatterloom.operators.blocks import SplitPolicy
from chatterloom.operators.messages import foldable_split, unsummarized_tail
from chatterloom.plans import compaction as P
from chatterloom.schemas import TABLES

CALL = [("c", "add_memory", {"note": "x"})]


def summaries(spark, data):
    full = [(t, s, c, None) for t, s, c in data]
    return spark.createDataFrame(full, TABLES["summary_context"])


def chat(n, size=4):
    return [("human" if i % 2 == 0 else "ai", "x" * size) for i in range(n)]


@pytest.mark.parametrize(
    "count, size, due",
    [
        (0 + 1, 1, False), (6, 9999, False), (7, 1, False), (20, 1, False), (21, 1, True),
        # seven messages: one foldable, 3000 tokens is not enough and 3001 is
        (7, 12_003, False), (7, 12_004, True),
    ],
)
def test_limits_are_strict(spark, count, size, due):
    m = make_messages(spark, chat(count, size))
    got = rows(P.compaction_candidates(m, summaries(spark, [])), "start", "tail_messages", "foldable_messages")
    assert got == ([(0, count, count - 6)] if due else [])


def test_tail_counts_from_the_boundary(spark):
    m = make_messages(spark, chat(30))
    assert P.compaction_candidates(m, summaries(spark, [("t", "s", 10)])).count() == 0
    got = rows(P.compaction_candidates(m, summaries(spark, [("t", "s", 9)])), "start", "foldable_messages")
    assert got == [(9, 15)]


def test_boundary_past_the_end_gives_an_empty_tail(spark):
    m, s = make_messages(spark, chat(5)), summaries(spark, [("t", "s", 9)])
    assert unsummarized_tail(m, s).count() == 0
    assert P.compaction_candidates(m, s).count() == 0
    split = foldable_split(make_messages(spark, chat(9)), summaries(spark, [("t", "s", 1)]))
    assert [r["position"] for r in split.orderBy("position").collect() if r["foldable"]] == [1, 2]


def test_block_content_counts_no_tokens_but_is_transcribed(spark):
    blocks = [("text", "y" * 50_000, None)]
    m = make_messages(spark, [("human", None, None, blocks), *chat(20)])
    got = P.fold_segments(m, summaries(spark, [])).first()
    assert got["transcript"].split("\n")[0] == "HUMAN: " + NON_TEXT
    assert P.compaction_candidates(m, summaries(spark, [])).first()["tokens"] == 14 * 4 // 4
    assert got["summarized_count"] == 15 and got["pages"] == 1


def test_prompt_has_an_update_form(spark):
    m = make_messages(spark, chat(40))
    w = Wording()
    fresh = P.fold_segments(m, summaries(spark, [("t", "", 0)])).first()["prompt"]
    update = P.fold_segments(m, summaries(spark, [("t", "old one", 3)])).first()["prompt"]
    assert fresh.startswith(w.fresh_lead) and fresh.endswith(w.prompt_tail)
    assert update.startswith(w.update_lead + "old one" + w.update_join)


@pytest.mark.parametrize("existing", ["", "s"])
def test_every_page_has_a_complete_prompt(spark, existing):
    w, m, s = Wording(), make_messages(spark, chat(40)), summaries(spark, [("t", existing, 3)])
    whole = P.fold_segments(m, s).first()
    assert whole["pages"] == 1 and "Part 1 of 1:" in whole["prompt"]
    pages = P.fold_segments(m, s, page_bytes=40, policy=SPLIT_ALL).orderBy("page").collect()
    assert [p["page"] for p in pages] == list(range(pages[0]["pages"])) and len(pages) > 5
    assert "\n".join(p["transcript"] for p in pages) == whole["transcript"]
    lead = w.update_lead + existing + w.update_join if existing else w.fresh_lead
    for p in pages:
        number = f"{w.part_lead}{p['page'] + 1}{w.part_of}{len(pages)}{w.part_end}"
        assert p["prompt"] == lead + number + p["transcript"] + w.prompt_tail


def test_a_line_longer_than_a_page_is_a_page(spark):
    m = make_messages(spark, [("human", "x" * 500), ("ai", "y"), ("ai", "\u00e9" * 300), *chat(20)])
    pages = P.fold_segments(m, summaries(spark, []), page_bytes=100).orderBy("page").collect()
    assert [p["page"] for p in pages] == list(range(len(pages)))
    assert pages[0]["transcript"] == "HUMAN: " + "x" * 500
    assert all(len(p["transcript"].encode()) <= 100 or "\n" not in p["transcript"] or p["transcript"].count("\n") < 20 for p in pages)


@pytest.mark.parametrize("fan_in", [2, 3, 64])
def test_summarizer_merges_pages_and_moves_the_boundary(spark, fan_in):
    w, m, s = Wording(), make_messages(spark, chat(40)), summaries(spark, [("t", "s", 3), ("u", "kept", 1)])
    segments = P.fold_segments(m, s, page_bytes=50)
    pages = segments.count()
    leads = (w.merge_lead, w.update_lead)

    def span(prompts: pd.Series) -> pd.Series:
        # Each prompt is complete; the answer lists the pages it stands for.
        assert prompts.str.startswith(leads).all() and prompts.str.endswith(w.prompt_tail).all()
        body = prompts.str.replace(w.prompt_tail, "", regex=False)
        merged = body.str.startswith(w.merge_lead)
        own = body.str.extract(r"Part (\d+) of", expand=False)
        below = body.str.split(w.part_end, n=1).str[1].str.replace(w.section_rule, ",", regex=False)
        return below.where(merged, own)

    new = P.apply_summaries(segments, span, fan_in=fan_in)
    assert rows(new) == [("t", ",".join(str(i + 1) for i in range(pages)), 34)]
    after = P.advance_summaries(s, new, F.expr("timestamp_ntz'2025-01-01'"))
    assert {(r["thread_id"], r["summarized_count"]) for r in after.collect()} == {("t", 34), ("u", 1)}
    assert m.count() == 40


def plain_boundaries(messages, cfg):
    """The rule as a loop over one thread's messages."""
    out, s = [], 0
    sizes = [len(c) if c is not None else 0 for _, c, _ in messages]
    for i, (kind, _, calls) in enumerate(messages):
        n = i + 1
        if kind != "ai" or calls or n - s <= cfg.keep_last:
            continue
        tokens = sum(sizes[s : n - cfg.keep_last]) // cfg.chars_per_token
        if tokens > cfg.max_tokens or n - s > cfg.max_messages:
            out.append((n, s, n - cfg.keep_last))
            s = n - cfg.keep_last
    return out


def random_thread(rng, n):
    kinds = ["human", "ai", "ai", "tool", "system"]
    out = []
    for _ in range(n):
        kind = rng.choice(kinds)
        content = None if rng.random() < 0.1 else "x" * rng.choice([0, 1, 5, 40, 200])
        out.append((kind, content, CALL if kind == "ai" and rng.random() < 0.3 else None))
    return out


CONFIGS = [
    CompactionConfig(60, 8, 3), CompactionConfig(10_000, 5, 2), CompactionConfig(20, 100, 6), CompactionConfig(3000, 4, 6),
    CompactionConfig(),
]


@pytest.mark.parametrize("cfg", CONFIGS)
@pytest.mark.parametrize("split, width, piece", [(SplitPolicy(), 65_536, 4), (SPLIT_ALL, 1, 256)])
def test_boundaries_equal_the_loop(spark, monkeypatch, cfg, split, width, piece):
    monkeypatch.setattr(P, "_PIECE", piece)
    rng = random.Random(cfg.max_tokens + cfg.max_messages)
    threads = {f"t{i}": random_thread(rng, n) for i, n in enumerate([0, 1, 5, 30, 400, 150])}
    m = make_threads(spark, threads)
    got = P.compaction_boundaries(m, cfg, split, width)
    want = sorted(
        ((name, no + 1, *b) for name, items in threads.items() for no, b in enumerate(plain_boundaries(items, cfg))), key=repr
    )
    assert rows(got, "thread_id", "boundary_no", "at_message", "previous_count", "summarized_count") == want
    # Every folded message is in one segment, numbered like the fold that took it.
    segments = {(r["thread_id"], r["position"]): r["segment"] for r in P.message_segments(m, got).collect()}
    assert len(segments) == m.count()
    for name, no, _, lo, hi in want:
        assert all(segments[(name, p)] == no for p in range(lo, hi))
    # Stored messages against what a model sees.
    sizes = P.context_size_per_turn(m, cfg, policy=split, width=width).collect()
    for name, items in threads.items():
        ends = [i + 1 for i, (k, _, c) in enumerate(items) if k == "ai" and not c]
        folds = plain_boundaries(items, cfg)
        mine = sorted((r["turn_no"], r["stored"], r["summarized"], r["seen"]) for r in sizes if r["thread_id"] == name)
        expect = []
        for turn, n in enumerate(ends, 1):
            s = max([f[2] for f in folds if f[0] < n], default=0)
            expect.append((turn, n - 1, s, n - 1 - s + (s > 0)))
        assert mine == expect
        if cfg.keep_last and folds:
            assert all(seen < stored for turn, stored, s, seen in mine if s > 1)



@pytest.mark.parametrize("cfg", [CompactionConfig(2_000, 10**9, 6), CompactionConfig(10**9, 30_000, 6)])
def test_blocks_do_not_widen_with_the_limits(spark, cfg):
    """A thread of 40,000 turn ends in blocks of 1,024, with a limit far wider than a block."""
    many = 80_000
    chars = "x" * 40
    kind = F.when(F.col("position") % 2 == 1, "ai").otherwise("human")
    m = spark.range(many).select(
        F.lit("long").alias("thread_id"), F.col("id").alias("position"), F.col("id").cast("string").alias("message_id"),
    ).select("*", kind.alias("type"), F.when(F.col("position") % 5 > 0, chars).alias("content"),
             *[F.lit(None).cast(TABLES["message"][c].dataType).alias(c) for c in ("blocks", "tool_calls")])
    items = [("ai" if i % 2 else "human", chars if i % 5 else None, None) for i in range(many)]
    want = [(no + 1, *b) for no, b in enumerate(plain_boundaries(items, cfg))]
    got = P.compaction_boundaries(m, cfg, width=1_024)
    assert rows(got, "boundary_no", "at_message", "previous_count", "summarized_count") == sorted(want, key=repr)


def test_cut_off_tool_result_is_flagged(spark):
    cfg = CompactionConfig(10_000, 4, 3)
    items = [("human", "a"), ("ai", "", CALL), ("tool", "r"), ("human", "b"), ("ai", "c"), ("human", "d"), ("ai", "e")]
    m = make_messages(spark, items)
    got = rows(P.context_size_per_turn(m, cfg), "turn_no", "summarized", "seen", "opens_on_tool")
    assert got == [(1, 0, 4, False), (2, 2, 5, True)]
    notes = spark.createDataFrame([("t", 7)], "thread_id string, note_tokens long")
    noted = rows(P.context_size_per_turn(m, cfg, notes), "turn_no", "seen", "note_tokens")
    assert noted == [(1, 5, 7), (2, 5, 7)]


def test_routes(spark):
    calling = make_messages(spark, [("human", "a"), ("ai", "", CALL)], "call")
    long = make_messages(spark, chat(30), "long")
    short = make_messages(spark, chat(2), "short")
    got = rows(P.route_turns(calling.unionByName(long).unionByName(short), summaries(spark, [])))
    assert got == [("call", "tools"), ("long", "summarize"), ("short", "end")]
