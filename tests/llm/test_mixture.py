import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chatterloom.llm import mixture
from chatterloom.llm.mixture import mix, weights
from chatterloom.llm.queries import op5_temperature_mix

SIZES = {"hot": 4000, "mid": 900, "small": 120, "tiny": 7}


def corpus(spark):
    rows, key = [], 0
    for source, tokens in SIZES.items():
        left = tokens
        while left:
            take = min(left, 1 + key % 9)
            rows.append((key, source, "abcd" * take, 5))
            left, key = left - take, key + 1
    rows += [(key, "blank", None, 5), (key + 1, "blank", "", 5), (key + 2, None, "abcdabcd", 5), (key + 2, None, "abcdabcd", 5)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, epoch int").repartition(3)


def model(sizes, entropy, max_epochs, budget=None, cover=False):
    total = sum(sizes.values())
    p = {s: t / total for s, t in sizes.items() if t}

    def at(a):
        z = sum(x**a for x in p.values())
        w = {s: x**a / z for s, x in p.items()}
        amount = max(sizes[s] / w[s] for s in p) if cover else budget or total
        return -sum(x * math.log(x) for x in w.values()), max(w[s] * amount / sizes[s] for s in p), {s: round(w[s] * amount) for s in p}

    def bisect(up):
        lo, hi = 0.0, 1.0
        if up(1.0):
            return 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if up(mid) else (lo, mid)
        return (lo + hi) / 2

    a = max(
        1.0 if entropy is None else bisect(lambda x: at(x)[0] >= entropy * math.log(len(p))),
        0.0 if max_epochs is None else bisect(lambda x: at(x)[1] > max_epochs),
    )
    return at(a)[2]


@pytest.mark.parametrize(
    "wish",
    [dict(entropy=0.9), dict(entropy=0.99, max_epochs=3.0), dict(max_epochs=1.5, cover=True), dict(entropy=0.7, budget=2500), dict()],
    ids=str,
)
def test_budgets_are_met(spark, wish):
    docs = corpus(spark)
    out = mix(docs, block_tokens=64, **wish).collect()
    sizes = {**SIZES, None: 4, "blank": 0}
    want = model(sizes, wish.get("entropy"), wish.get("max_epochs"), wish.get("budget"), wish.get("cover", False))
    used, seen = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in out:
        used[r.source] += r.tokens
        seen[r.source][r.epoch] += r.tokens
    for source, budget in want.items():
        assert budget - 9 < used[source] <= budget, source  # short by less than a document
        for epoch, tokens in seen[source].items():
            assert tokens == sizes[source] or epoch == max(seen[source])
    assert sum(r.source == "blank" for r in out) == 2
    if wish.get("cover"):
        assert {r.doc_id for r in out} == {r.doc_id for r in docs.select("doc_id").collect()}
    starts = sorted((r.start, r.start + r.tokens) for r in out if r.source == "hot" and r.epoch == 0)
    assert all(a[1] == b[0] for a, b in zip(starts, starts[1:])) and starts[0][0] == 0
    assert mix(docs, **wish).columns == ["doc_id", "source", "text", "tokens", "epoch", "start"]


def test_epochs_differ_in_order(spark):
    out = mix(corpus(spark), entropy=1.0, block_tokens=16).filter("source = 'small'")
    order = lambda e: [r.doc_id for r in out.filter(F.col("epoch") == e).orderBy("start").collect()]
    assert sorted(order(0)) == sorted(order(1)) and order(0) != order(1)


def test_bounds_and_empty(spark):
    assert mix(corpus(spark).limit(0), entropy=0.9).count() == 0
    assert weights(spark.range(0).selectExpr("false _none", "string(id) _s", "id _t"), entropy=0.9).count() == 0


def test_rows_without_tokens_stay_in_whole_epochs(spark):
    rows = [(0, "one", "abcd" * 640)] + [(k, "one", "" if k % 2 else None) for k in range(1, 41)] + [(k, "two", "abcd" * 9) for k in range(50, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mix(docs, block_tokens=64, cover=True, entropy=1.0).collect()
    for source, keys in (("one", set(range(41))), ("two", set(range(50, 60)))):
        assert {r.doc_id for r in out if r.source == source and r.epoch == 0} == keys


def test_query_mixes_whole_texts(spark, monkeypatch):
    made = []
    monkeypatch.setattr(mixture, "mix", lambda *a, **b: made.append(mix(*a, **b)) or made[0])
    out = op5_temperature_mix(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.md5("text").alias("want"))
    same = made[0].join(docs, "doc_id").filter(F.md5("text").eqNullSafe(F.col("want"))).count()
    assert same == out.count() > 0


INTERNAL = ["_row", "_tokens", "_s", "_none", "_k", "_x", "_block", "_epoch", "_from", "_limit", "_end", "_a", "_all", "_blocks", "_whole", "_part", "_t", "f"]


def test_input_columns_of_any_name_are_kept(spark):
    rows = [(i, "ab"[i % 5 == 0], "abcd" * (i % 7), *[f"{n}{i}" for n in INTERNAL]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in INTERNAL))
    out = mix(docs, cover=True, entropy=1.0, max_epochs=3.0, block_tokens=16)
    assert out.columns == [*docs.columns, "tokens", "epoch", "start"]
    got = [tuple(r) for r in out.select(docs.columns).collect()]
    assert set(got) == set(rows) and len(got) > len(rows)


def test_any_number_of_sources(spark):
    """More sources than one row could hold well: sizes are counted, so a row per size meets."""
    sources = spark.range(300_000).selectExpr("false AS _none", "cast(id AS string) AS _s", "cast(pow(id % 5, 6) AS long) AS _t")
    plan = weights(sources, entropy=0.99).agg(
        F.count("*").alias("n"), F.sum("weight").alias("w"), F.countDistinct("exponent").alias("e"), F.max("exponent").alias("a")
    ).first()
    assert plan.n == 300_000 and abs(plan.w - 1) < 1e-9 and plan.e == 1 and 0 < plan.a < 1
    few = {str(i): (i % 5) ** 6 for i in range(50)}
    got = weights(spark.createDataFrame([(False, s, t) for s, t in few.items()], "_none boolean, _s string, _t long"), entropy=0.99)
    assert {r._s: r.budget for r in got.collect() if few[r._s]} == model(few, 0.99, None)


def test_registered_query_repeats_and_cuts(spark):
    out = op5_temperature_mix(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("concat('tier-', length(bin(doc_id % 64))) AS source")
    given = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    seen = {r["source"]: (r.docs, r.last) for r in out.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"), F.max("epoch").alias("last")).collect()}
    exponents = {r.exponent for r in out.select("exponent").distinct().collect()}
    assert len(exponents) == 1 and 0 < min(exponents) < 1
    assert seen["tier-1"][0] == given["tier-1"] and seen["tier-1"][1] >= 1  # the smallest goes in more than once
    assert seen["tier-6"][0] < given["tier-6"] and seen["tier-6"][1] == 0  # of the largest a part
    part = out.filter("source = 'tier-1'").groupBy("epoch").count().orderBy("epoch").collect()
    assert part[-1]["count"] < part[0]["count"]  # and a last epoch is cut
