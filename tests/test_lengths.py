import random

import pytest
from conftest import make_threads, rows
from pyspark.sql import functions as F

from chatterloom import CompactionConfig
from chatterloom.plans import compaction as P
from chatterloom.plans import lengths as L

CFG = CompactionConfig(30, 6, 2)


def made(spark, seed=3, threads=12):
    rng = random.Random(seed)
    items = lambda: [("human", rng.choice([None, "", "x" * rng.randint(1, 30)]), None) for _ in range(rng.randint(0, 40))]
    return make_threads(spark, {f"t{i}": items() for i in range(threads)})


def stored_counts(spark, seed=9):
    rng = random.Random(seed)
    # Some boundaries lie past the end, some threads have none.
    data = [(f"t{i}", "s", rng.randint(0, 45)) for i in range(0, 12, 2)]
    return spark.createDataFrame(data, "thread_id string, summary string, summarized_count int")


@pytest.mark.parametrize("width", [1, 5, 4096])
def test_candidates_equal_the_scan(spark, width):
    m, s = made(spark), stored_counts(spark)
    got = L.candidates_from_blocks(L.length_blocks(m, width), m, s, CFG, width)
    want = P.compaction_candidates(m, s, CFG)
    assert got.columns == want.columns and rows(got) == rows(want) and want.count() > 3


@pytest.mark.parametrize("width", [1, 7])
def test_kept_sums_equal_fresh_ones(spark, width):
    m = made(spark, 4).persist()
    day = F.col("position") % 3 + F.col("position") / 20  # later positions come on later days, for the most part
    blocks = L.length_blocks(m.filter(day < 1), width)
    blocks = L.advance(blocks, m.filter((day >= 1) & (day < 2)), width)
    blocks = L.advance(blocks, m.filter(day >= 2), width)
    assert rows(blocks, "thread_id", "block", "messages", "chars") == rows(L.length_blocks(m, width), "thread_id", "block", "messages", "chars")
    # Texts written over in place.
    hit = F.col("position") % 4 == 1
    after = m.withColumn("content", F.when(hit, F.lit("rewritten")).otherwise(F.col("content")))
    edits = m.filter(hit).select("thread_id", "position", F.col("content").alias("before"), F.lit("rewritten").alias("after"))
    blocks = L.edited(blocks, edits, width)
    assert rows(blocks, "thread_id", "block", "messages", "chars") == rows(L.length_blocks(after, width), "thread_id", "block", "messages", "chars")
    # Message 9 goes, the ones after it move up; t5 loses all from 3 on, t7 everything.
    gone = (F.col("position") == 9) | ((F.col("thread_id") == "t5") & (F.col("position") >= 3)) | (F.col("thread_id") == "t7")
    moved = after.filter(~gone).withColumn(
        "position", F.col("position") - F.when(F.col("position") > 9, 1).otherwise(0)
    )
    changed = after.filter(gone).select("thread_id", "position")
    blocks = L.refresh(blocks, moved, changed, width)
    assert rows(blocks, "thread_id", "block", "messages", "chars") == rows(L.length_blocks(moved, width), "thread_id", "block", "messages", "chars")


def test_no_threads(spark):
    m, s = made(spark).limit(0), stored_counts(spark)
    assert L.candidates_from_blocks(L.length_blocks(m), m, s, CFG).count() == 0
