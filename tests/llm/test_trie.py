import hashlib
import random
import re

import numpy as np
import pytest

from chatterloom.llm import trie as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FIELDS = "conv_id long, turn long, role string, text string"


def plain(rows, members=()):
    """All nodes, by looking at every prefix of every conversation."""
    last, talks = 2**63 - 1, {k if k is not None else 2**63 - 1: [] for k in members}
    for key, turn, role, text in rows:
        talks.setdefault(last if key is None else key, []).append((turn, role or "", text or ""))
    nodes = {}
    for key, said in talks.items():
        said.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
        path = tuple(t[1:] for t in said)
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((key, d == len(path)))
    shown = lambda k: None if k == last else k
    kids = {}
    for path in nodes:
        kids.setdefault(path[:-1], []).append(path) if path else None
    below = {path: [0, 0] for path in nodes}
    for path, met in nodes.items():
        own = (len(met) - 1) * len(WORD.findall(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            below[path[:d]][0] += path not in kids
            below[path[:d]][1] += own
    out = []
    for path, met in nodes.items():
        ends = ",".join("" if k == last else str(k) for k, over in sorted(met) if over)
        out.append((
            shown(min(met)[0]), len(path), shown(min(nodes[path[:-1]])[0]) if path else None, len(met), len(kids.get(path, [])),
            *below[path], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def talks(seed=1):
    rng, rows = random.Random(seed), []
    said = [("system", "You are kind."), ("user", "hi"), ("assistant", "hello there  friend"), ("user", ""), (None, "x y"), ("user", None)]
    for key in range(-20, 120):
        depth = rng.choice([1, 2, 3, 4, 5, 9, 17])
        path = [said[0], said[1]] if rng.random() < 0.6 else []
        path += [rng.choice(said if rng.random() < 0.8 else [("user", f"only {key}")]) for _ in range(depth)]
        rows += [(key, t, *turn) for t, turn in enumerate(path)]
    rows += [(k, t, *said[t % 3]) for k in (200, 201, 202, 9) for t in range(2)]
    rows += [(300, t, "user", f"turn {t // 40}") for t in range(200)] + [(301, t, "user", f"turn {t // 40}") for t in range(170)]
    rows += [(None, None, "user", "no key"), (None, 1, "user", "hi"), (302, 0, "user", "long " * 60_000)]
    return rows + rows[:2]


@pytest.mark.parametrize("shard_turns", [1, 40, P.SHARD_TURNS])
def test_equals_plain_loop(spark, shard_turns):
    rows, members = talks(), [1, 2, 500, 501, None]
    turns = spark.createDataFrame([(*r, "a", "b") for r in rows], FIELDS + ", path string, n string").repartition(4)
    known = spark.createDataFrame([(m, 1) for m in members * 2], "conv_id long, key int")
    got = P.prefix_trie(turns, known, shard_turns=shard_turns)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, members)


def test_small_batches_and_parts(spark, monkeypatch):
    rows = talks(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = P.prefix_trie(spark.createDataFrame(rows, FIELDS).repartition(4), shard_turns=12)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(20))
def test_double_array_holds_its_sequences_and_no_more(seed):
    rng = np.random.default_rng(seed)
    many = int(rng.integers(1, 300))
    sequences = [tuple(rng.integers(0, rng.integers(1, many + 1), rng.integers(0, 7)).tolist()) for _ in range(300)]
    flat = np.array([x for s in sequences for x in s], np.int64)
    made = P.DoubleArray(flat, np.append(0, np.cumsum([len(s) for s in sequences])))
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    slots = {(): 0}
    for path in sorted(prefixes, key=len):
        if path:
            slot = int(made.step(np.array([slots[path[:-1]]]), np.array([path[-1]]))[0])
            assert slot > 0 and made.check[slot] == slots[path[:-1]]
            slots[path] = slot
    assert len(set(slots.values())) == len(prefixes) == (made.check >= 0).sum() + 1
    for path in rng.permutation(np.array(sorted(prefixes, key=len), object))[:50]:
        for x in range(many + 2):
            if (*path, x) not in prefixes:
                assert made.step(np.array([slots[tuple(path)]]), np.array([x]))[0] == -1
    assert len(made.check) <= 3 * len(prefixes) + many


def test_shards_stay_within_their_turns(spark):
    rows = [(k, t, "user", f"same {t}" if t < 5 else f"{k} {t}") for k in range(400) for t in range(7)]
    talks = P._paths(spark.createDataFrame(rows, FIELDS), None, "conv_id", "turn", "role", "text")
    paths = talks.withColumnsRenamed({"key": "first"}).selectExpr("*", "1L AS n", "'' AS sha")
    sizes = P._sharded(paths, 64).groupBy("g").agg({"level": "max", "*": "count"}).collect()
    assert all(r["count(1)"] == 1 and r["max(level)"] == 8 for r in sizes) and len(sizes) == 400


def test_empty(spark):
    assert P.prefix_trie(spark.createDataFrame([], FIELDS)).count() == 0
    alone = P.prefix_trie(spark.createDataFrame([], FIELDS), spark.createDataFrame([(7,), (3,)], "conv_id long")).collect()
    assert [tuple(r) for r in alone] == [(3, 0, None, 2, 0, 1, 0, hashlib.sha256(b"3,7").hexdigest())]
