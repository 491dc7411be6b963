import random

import numpy as np
import pandas as pd
import pytest
from conftest import make_messages, rows
from pyspark.sql import functions as F
from test_compaction import CALL, random_thread

from catalog.queries import REGISTRY
from chatterloom import CompactionConfig
from chatterloom.operators.messages import message_count
from chatterloom.plans.compaction import compaction_boundaries
from chatterloom.streaming import compaction as C
from chatterloom.streaming import events as S
from chatterloom.streaming.snapshot import KeyedSnapshot, upsert_batches

CFG = CompactionConfig(60, 8, 3)


def source(spark, tmp_path, frames):
    """A stream over one written folder per batch, one batch per trigger."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    return (
        spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    )


def run(stream, tmp_path, mode, **options):
    S.write_batches(stream, f"{tmp_path}/out", f"{tmp_path}/ck", mode, **options).awaitTermination()
    return f"{tmp_path}/out"


def log(spark, seed, n=120):
    rng = random.Random(seed)
    frames = [make_messages(spark, random_thread(rng, n), f"t{i}") for i in range(3)]
    m = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return m.withColumn("seq", F.col("position")).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' SECOND * seq"))


def test_counters_equal_batch(spark, tmp_path):
    m = log(spark, 1)
    parts = [m.filter("seq < 50"), m.filter("seq >= 50 and seq < 51"), m.filter("seq >= 51")]
    out = run(S.thread_state(source(spark, tmp_path, parts)), tmp_path, "update")
    assert rows(S.latest_thread_state(spark, out), "thread_id", "message_count") == rows(message_count(m))


def test_liveness_follows_removals_in_any_order(spark, tmp_path):
    log = [("t", "a", 1, "append"), ("t", "b", 2, "append"), ("t", "a", 3, "remove"), ("t", "b", 4, "append"), ("t", "c", 5, "append"),
           ("t", "a", 6, "append"), ("t", "c", 7, "remove"), ("u", "x", 1, "append"), ("u", "x", 2, "remove")]
    df = spark.createDataFrame(log, "thread_id string, message_id string, seq long, op string").withColumn(
        "ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' SECOND * seq")
    )
    late_first = [df.filter("seq > 5"), df.filter("seq between 3 and 5"), df.filter("seq < 3")]
    out = run(S.message_liveness(source(spark, tmp_path, late_first)), tmp_path, "update")
    assert rows(S.live_thread_state(spark, out), "thread_id", "message_count") == [("t", 2), ("u", 0)]


def ticked(m, day=1):
    """A row that moves the clock on by days."""
    first = {"op": F.lit("tick"), "ts": F.expr(f"timestamp_ntz'2024-01-01' + INTERVAL '{day}' DAY"), "seq": F.lit(0)}
    row = m.sparkSession.range(1)
    return row.select(*[first.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in m.schema])


def test_compaction_equals_batch_and_reports_late_rows(spark, tmp_path):
    m = log(spark, 2).withColumn("op", F.lit("append"))
    late = m.filter("thread_id = 't0' and seq in (3, 4)")
    early = (F.col("seq") % 9 == 8) & (F.col("seq") < 110)  # these overtake up to eight others
    parts = [m.filter((F.col("seq") < 40) | early & (F.col("seq") < 48)), m.filter((F.col("seq") >= 40) & (F.col("seq") < 77) & ~(early & (F.col("seq") < 48))),
             late, m.filter("seq >= 77"), ticked(m)]
    stream = C.compaction(source(spark, tmp_path, parts), CFG, lateness_seconds=10)
    out = spark.read.parquet(run(stream, tmp_path, "append", keyed_state=True))
    columns = ("thread_id", "boundary_no", "at_message", "summarized_count")
    folds = out.filter("kind = 'fold'")
    assert folds.count() > 5 and rows(folds, *columns) == rows(compaction_boundaries(m, CFG), *columns)
    assert rows(out.filter("kind = 'late'"), "thread_id", "seq") == [("t0", 3), ("t0", 4)]
    assert spark.conf.get(S.STATE_STORE, None) is None or "RocksDB" not in spark.conf.get(S.STATE_STORE)


def test_compaction_holds_rows_until_the_watermark_has_passed(spark, tmp_path):
    m = log(spark, 3).filter("thread_id = 't1'").withColumn("op", F.lit("append"))
    stream = C.compaction(source(spark, tmp_path, [m.filter("seq < 60")]), CFG, lateness_seconds=20)
    folds = spark.read.parquet(run(stream, tmp_path, "append", keyed_state=True))
    assert folds.agg(F.max("seq")).first()[0] <= 40
    want = compaction_boundaries(m.filter("seq < 20"), CFG).count()
    assert folds.count() >= want > 0


def simulate(events, cfg):
    """The rule with a plain list of messages: (seq, number, messages, boundary) of every fold."""
    thread, boundary, out = [], 0, []
    for seq, op, id_, chars, is_end in events:
        at = next((i for i, m in enumerate(thread) if m[0] == id_), None)
        if op == "remove":
            if at is not None:
                del thread[at]
            continue
        if at is not None:
            thread[at] = (id_, chars)
            continue
        thread.append((id_, chars))
        tail = thread[boundary:]
        foldable = sum(c for _, c in (tail[: -cfg.keep_last] if cfg.keep_last else tail))
        if is_end and len(tail) > cfg.keep_last and (foldable // cfg.chars_per_token > cfg.max_tokens or len(tail) > cfg.max_messages):
            boundary = len(thread) - cfg.keep_last
            out.append((seq, len(out) + 1, len(thread), boundary))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_replay_with_edits_equals_a_plain_list(seed):
    rng = random.Random(seed)
    cfg = CompactionConfig(rng.choice([0, 20, 10**6]), rng.choice([0, 5, 10**9]), rng.choice([0, 1, 4]))
    events, ids = [], []
    for seq in range(rng.choice([1, 60, 400])):
        op = rng.choices(["new", "over", "remove", "unknown"], [8, 1, 2, 0.3])[0]
        id_ = f"m{seq}" if op in ("new", "unknown") or not ids else rng.choice(ids[-25:])
        if op in ("new", "over"):
            ids.append(id_)
        events.append((seq, "append" if op in ("new", "over") else "remove", id_, rng.choice([0, 1, 40]), rng.random() < 0.5))
    frame = pd.DataFrame(events, columns=["seq", "op", "id", "chars", "is_end"])
    tail, present, place, got, at = C.Tail(cfg), {}, 0, [], 0
    while at < len(frame):  # in pieces, with only the kept state in between
        part = frame.iloc[at : at + rng.choice([1, 7, 500])].reset_index(drop=True)
        found, touched, place = C.replay(tail, part, present.get, place)
        present = {k: v for k, v in {**present, **touched}.items() if v is not None}
        got += [(int(part["seq"][i]), *rest) for i, *rest in found]
        at += len(part)
        tail = C.Tail(cfg, tail.messages, tail.summarized, tail.folds, tail.places.tolist(), tail.chars.tolist())
        assert len(tail.places) == max(tail.messages - tail.summarized, 0) and (np.diff(tail.places) > 0).all()
    assert got == simulate(events, cfg) and tail.messages == len(present)


def test_compaction_of_an_edited_log_in_many_batches(spark, tmp_path):
    rng, events, ids = random.Random(9), [], {}
    for seq in range(240):
        thread = rng.choice(["t", "u", None])
        known = ids.setdefault(thread, [])
        op = rng.choices(["new", "over", "remove"], [8, 1, 2])[0] if known else "new"
        id_ = f"{seq}" if op == "new" else rng.choice(known[-12:])
        known.append(id_)
        kind = rng.choice(["human", "ai"])
        events.append((thread, seq, rng.randrange(2), "remove" if op == "remove" else "append", id_, kind, "x" * rng.choice([0, 3, 90])))
    fields = "thread_id string, seq long, sub int, op string, message_id string, type string, content string"
    df = spark.createDataFrame(events, fields).withColumn("tool_calls", F.expr("cast(null as array<struct<id: string>>)"))
    df = df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' SECOND * seq"))
    parts = [df.filter(F.col("seq").between(lo, lo + 39)) for lo in range(0, 240, 40)]
    cfg = CompactionConfig(30, 6, 2)
    out = run(C.compaction(source(spark, tmp_path, [*parts, ticked(df)]), cfg, 15), tmp_path, "append", keyed_state=True)
    want = []
    for thread in ids:
        own = [(e[1], e[3], e[4], len(e[6]), e[5] == "ai") for e in events if e[0] == thread]
        want += [(thread, *f) for f in simulate(own, cfg)]
    assert rows(spark.read.parquet(out), "thread_id", "seq", "boundary_no", "at_message", "summarized_count") == sorted(want, key=repr)


def test_notes_duplicates_and_answers(spark, tmp_path):
    items = [("human", "a"), ("ai", "", CALL), ("ai", "done"), ("ai", "", [("d", "forget_memory", {"note_id": "zz"})])]
    m = make_messages(spark, items).withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + INTERVAL '1' MINUTE * position"))
    owner = spark.createDataFrame([("t", "p")], "thread_id string, profile_id string")
    stream = source(spark, tmp_path, [m.filter("position < 2"), m.filter("position >= 2"), m])
    fresh = S.distinct_messages(stream)
    out = run(fresh, tmp_path / "dedup", "append")
    assert rows(spark.read.parquet(out), "message_id") == [(f"t-{i}",) for i in range(4)]
    out = run(S.note_events(stream, owner), tmp_path / "notes", "append")
    assert rows(S.current_notes(spark, out), "profile_id", "text") == [("p", "x")]
    puts = S.note_events(stream, owner)
    notes = KeyedSnapshot(f"{tmp_path}/current", puts.schema, ["profile_id", "note_id"], ["seq", "sub", "op"], buckets=4)
    upsert_batches(puts, notes, f"{tmp_path}/current-ck").awaitTermination()
    assert rows(notes.read(spark), "profile_id", "text") == [("p", "x")]
    out = run(S.final_responses(stream), tmp_path / "answers", "append")
    assert set(rows(spark.read.parquet(out), "response")) == {("done",)}


def test_replayed_batch_counts_once(spark, tmp_path):
    m = make_messages(spark, [("ai", "x")])
    out = run(S.final_responses(source(spark, tmp_path, [m])), tmp_path, "append")
    again = S.write_batches(S.final_responses(
        spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in")), out, f"{tmp_path}/ck2", "append")
    again.awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_snapshot_equals_the_newest_rows_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    events = [(rng.choice(["p", "q", None]), f"n{rng.randrange(30)}", s, rng.choice(["put", "put", "delete"]), f"text {s}") for s in range(300)]
    fields = "profile_id string, note_id string, seq long, op string, text string"
    latest = {}
    for e in events:
        latest[e[:2]] = e
    want = sorted(((p, n, s, x) for p, n, s, op, x in latest.values() if op == "put"), key=repr)
    rng.shuffle(events)
    frames = [spark.createDataFrame(events[i : i + 60], fields) for i in range(0, 300, 60)]
    table = KeyedSnapshot(f"{tmp_path}/t", frames[0].schema, ["profile_id", "note_id"], ["seq"], buckets=5)
    assert rows(table.read(spark)) == []
    for i, frame in enumerate(frames):
        table.merge(frame, i)
    assert rows(table.read(spark)) == want
    files = sorted(str(f) for f in (tmp_path / "t").rglob("*.parquet"))
    table.merge(frames[-1], len(frames) - 1)  # a replay writes its own folder again and no other
    assert rows(table.read(spark)) == want
    again = sorted(str(f) for f in (tmp_path / "t").rglob("*.parquet"))
    assert [f for f in files if "batch_id=4" not in f] == [f for f in again if "batch_id=4" not in f]
    versions = [f for f in again if "_bucket=0" in f]
    assert len({f.split("batch_id=")[1].split("/")[0] for f in versions}) <= 2


def test_snapshot_does_not_see_unfinished_batches_and_leaves_other_buckets(spark, tmp_path):
    fields = "k long, seq long, op string"
    table = KeyedSnapshot(f"{tmp_path}/t", spark.createDataFrame([], fields).schema, ["k"], ["seq"], buckets=16)
    table.merge(spark.createDataFrame([(k, 0, "put") for k in range(200)], fields), 0)
    table.merge(spark.createDataFrame([(7, 1, "delete")], fields), 1)
    assert len(list((tmp_path / "t" / "batch_id=1").glob("_bucket=*"))) == 1
    assert table.read(spark).count() == 199
    table.merge(spark.createDataFrame([(8, 1, "delete")], fields), 2)
    (tmp_path / "t" / "batch_id=2" / "_SUCCESS").unlink()  # as if it had died before it was done
    assert table.read(spark).count() == 199
    table.merge(spark.createDataFrame([(8, 1, "delete")], fields), 2)
    table.merge(spark.createDataFrame([], fields), 3)
    assert table.read(spark).count() == 198
    with pytest.raises(ValueError):
        KeyedSnapshot(f"{tmp_path}/t", table.schema, ["k"], ["seq"], buckets=8).merge(spark.createDataFrame([], fields), 4)


@pytest.mark.parametrize("files", [0, 2])
def test_streams_of_a_table_in_a_file_or_a_folder(spark, tmp_path, files):
    turns = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}") for c in range(12) for t in range(4)]
    table = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "int32"})
    to = f"{tmp_path}/conversations.parquet"
    if files:
        spark.createDataFrame(table).repartition(files).write.parquet(to)
    else:
        table.to_parquet(to)
    counted = rows(REGISTRY["stream_thread_state"](spark, str(tmp_path)), "thread_id", "message_count")
    assert counted == [(str(c), 8 if c < 2 else 4) for c in range(10)]
    answers = rows(REGISTRY["stream_final_responses"](spark, str(tmp_path)))
    assert answers == sorted((str(c % 10), f"{c}-1", f"text {c} 1") for c in range(12))
    assert REGISTRY["stream_notes"](spark, str(tmp_path)).count() == 12
