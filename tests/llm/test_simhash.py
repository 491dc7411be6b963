import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from chatterloom.llm import kernels as K
from chatterloom.llm import simhash as S

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    ws = WORD.findall((text or "").encode().lower())
    if not ws:
        return 0
    grams = [b" ".join(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    """Fingerprint and least reachable key of every (key, text)."""
    fps = [plain_fingerprint(t) for _, t in rows]
    near = [[j for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 3] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((key, f"{fps[i]:016x}", min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=repr)


def components_of(values, radius=3):
    label = np.arange(len(values))
    for i in range(len(values)):
        near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius)
        S.merge(label, near, np.full(len(near), i))
    return label


def test_fingerprints_equal_plain_ones_and_spark_hashes(spark):
    texts = ["", "  \n", "One", "two Words", "a b c", "A\tB\n\nC d", "é É x y z z z z", "\x1c odd\x85 \x0b end", "w " * 70_000, "x" * 300]
    batch = K.pa.RecordBatch.from_arrays([K.pa.array([*texts, None])], names=["text"])
    got = S.fingerprints(*K.utf8(batch.column(0)))
    assert got.tolist() == [plain_fingerprint(t) for t in [*texts, None]]
    signed = spark.range(1).select(F.xxhash64(F.lit("two words é"))).first()[0]
    assert signed % 2**64 == xxh64_intdigest("two words é".encode(), 42)


@pytest.mark.parametrize("spread", [6, 20, 64])
def test_trees_find_all_pairs(spread):
    rng = np.random.default_rng(spread)
    bits = rng.choice(64, spread, replace=False)
    values = np.unique(np.bitwise_or.reduce(rng.integers(0, 2, (500, spread)).astype(np.uint64) << bits.astype(np.uint64), axis=1))
    group = np.sort(rng.integers(0, 3, len(values)))
    _, group = np.unique(group, return_inverse=True)
    forest, found = S.Forest(group, values), set()
    for a, b in forest.within(np.arange(len(values)), 3):
        found |= set(zip(a.tolist(), b.tolist()))
    want = {
        (i, j) for i in range(len(values)) for j in range(i)
        if group[i] == group[j] and (int(values[i]) ^ int(values[j])).bit_count() <= 3
    }
    assert found == want
    # an edge's key is the distance of its ends, and siblings have different keys
    parents, keys = forest.edges // 65, forest.edges % 65
    assert (np.bitwise_count(values[parents] ^ values[forest.children]) == keys).all()
    assert len(np.unique(forest.edges)) == len(forest.edges) == len(values) - len(np.unique(group))


def test_masks_let_every_pair_meet_and_bound_a_shard():
    config, rng = S.SimHashConfig(), random.Random(1)
    levels = S.shard_masks(config)
    first, second, third = next(levels), next(levels), next(levels)
    assert [len(x) for x in (first, second, third)] == [20, 400, 8000]
    assert 64 - min(int(m).bit_count() for m in third) <= 9 and 1 << 9 == S.LEAST_SHARD
    for _ in range(300):
        pair = sum(1 << b for b in rng.sample(range(64), 3))
        meets = [i for i, m in enumerate(first.tolist()) if not pair & m]
        assert meets
        for i in meets:  # wherever they meet, they meet again when that shard is dealt anew
            assert any(not pair & m for m in second[i * 20 : i * 20 + 20].tolist())


def test_crowded_shards_are_dealt_again(spark):
    """All fingerprints agree on 50 bits, so that shards of the first dealings exceed the least bound."""
    rng = np.random.default_rng(5)
    free = rng.choice(64, 14, replace=False).astype(np.uint64)
    dense = np.bitwise_or.reduce(rng.integers(0, 2, (2500, 14)).astype(np.uint64) << free, axis=1)
    sparse = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    chain = [int(sparse[0])]
    for b in range(0, 60, 3):
        chain.append(chain[-1] ^ (0b111 << b))
    values = np.unique(np.concatenate([dense, sparse, np.array(chain, np.uint64)]))
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = S.linked_fingerprints(nodes, S.SimHashConfig(shard_nodes=512)).collect()
    assert all((e.u ^ e.v) % 2**64 for e in edges)
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    label = np.arange(len(values))
    S.merge(label, np.array([place[e.u] for e in edges]), np.array([place[e.v] for e in edges]))
    assert (label == components_of(values)).all()


def test_equals_brute_force(spark):
    rng, rows = random.Random(2), []
    words = [f"Wort{i}" for i in range(400)]
    for group in range(8):
        base = [rng.choice(words) for _ in range(150 + group * 100)]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = "changed"
            rows.append((len(rows) * 3 % 101, " ".join(text)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "two words"), (906, "long " * 30_000)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (None, "no key here at all"), (None, "no key here at all"), (rows[3][0], "same key, other text")]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, fp string, id string").repartition(3)
    got = sorted((tuple(r) for r in S.near_duplicates(docs).collect()), key=repr)
    assert got == plain(rows)


def test_empty(spark):
    made = S.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert made.columns == ["doc_id", "fingerprint", "component_id"] and made.count() == 0
