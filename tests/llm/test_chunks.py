import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from chatterloom.llm import chunks as C
from chatterloom.llm import kernels as K

RNG = random.Random(5)
TEXTS = ["", "é", "short", "a" * 5000, "".join(RNG.choice("abc äöü\n") for _ in range(30_000)), "x y z " * 90]
TEXTS += [" ".join(RNG.choice(["lorem", "ipsum", "dolor", "ña"]) for _ in range(RNG.randrange(1, 400))) for _ in range(60)]


def slow_cuts(raw, config):
    out, start, h = [], 0, 0
    rolled = []
    for b in raw:
        h = ((h << 1) + int(C._GEAR[b])) % (1 << 32)
        rolled.append(h)
    while start < len(raw):
        end = min(start + config.most, len(raw))
        for i in range(start + config.least, end + 1):
            bits = config.hard_bits if i < start + config.normal else config.easy_bits
            if rolled[i - 1] >> (32 - bits) == 0:
                end = i
                break
        out.append((start, end))
        start = end
    return out


def test_cuts_equal_a_plain_loop():
    data, offsets = K.utf8(pa.array(TEXTS))
    owner, start, end = C.cuts(data, offsets)
    for i, text in enumerate(TEXTS):
        got = [(s - offsets[i], e - offsets[i]) for s, e in zip(start[owner == i], end[owner == i])]
        assert got == slow_cuts(text.encode(), C.ChunkConfig())


def marks(text):
    value, length, _ = C.digests(*K.utf8(pa.array([text])))
    return value, length


def test_containment_survives_a_shift():
    text = TEXTS[4]
    a, b = marks(text), marks("some words in front " + text)
    assert C.containment(*a, b[0]) > 0.99 and C.containment(*a, marks(TEXTS[5])[0]) == 0
    assert C.containment(*marks(""), a[0]) == 1 and C.containment(*a, marks("")[0]) == 0
    half = marks(text[:15_000])
    assert C.containment(*half, a[0]) > 0.99 and 0.45 < C.containment(*a, half[0]) < 0.55


@pytest.mark.parametrize("run_bytes", [900, 1 << 23])
def test_edited_fingerprints(spark, run_bytes):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(500, None), (None, "null key"), (3, "same key, other text"), (6, TEXTS[2])]
    docs = spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = C.edited_fingerprints(docs, run_bytes=run_bytes).collect()
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1]):
        e = C.edited(t, n)
        a, b, c = marks(t), marks(e), marks(n)
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), C.shown(*a), C.shown(*b), C.containment(*a, b[0]), C.containment(*a, c[0])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert C.edited_fingerprints(docs.limit(0)).count() == 0


def test_keys_of_other_types_over_several_runs(spark):
    texts = [f"{TEXTS[4][i * 40 : i * 40 + 900]} {i}" for i in range(60)]
    words = [(f"k\u00e9{i * 7 % 60:02d}\"'", t) for i, t in enumerate(texts)] + [(None, "none")]
    for kind, cast in [("string", str), ("double", None), ("date", None)]:
        rows = words if cast else [(i, t) for i, (_, t) in enumerate(words)]
        docs = spark.createDataFrame(rows, f"k {'string' if cast else 'int'}, text string")
        if kind == "double":
            docs = docs.selectExpr("k / 8.0D - 2 AS k", "text")
        if kind == "date":
            docs = docs.selectExpr("date_add(date'2024-01-01', k) AS k", "text")
        known = sorted((tuple(r) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0) if r[0] is not None else (False, 0))
        got = {(r.k, r.n_chars): r.edited_sha256 for r in C.edited_fingerprints(docs, key="k", run_bytes=3000).collect()}
        assert len(got) == len(rows)
        for (k, t), (_, n) in zip(known, known[1:] + known[:1]):
            assert got[k, len(t)] == hashlib.sha256(C.edited(t, n).encode()).hexdigest()


def test_fingerprint_column(spark):
    docs = spark.createDataFrame([(1, "abc" * 50, "x"), (2, "abc" * 50, "y"), (3, None, "z")], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r.fingerprint for r in C.fingerprints(docs).collect()}
    assert got[1] == got[2] != "" and got[3] == "" and np.isfinite(len(got[1]))
