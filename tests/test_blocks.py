import random

import pandas as pd
import pytest
from conftest import SPLIT_ALL, rows
from pyspark.sql import functions as F

from chatterloom.operators.blocks import SplitPolicy, hot_key_cuts, rows_in_spans, running


def skewed(seed):
    rng = random.Random(seed)
    out = []
    for key, size in (("hot", 300), ("warm", 40), ("one", 1), (None, 5)):
        order = rng.sample(range(10_000), size)
        out += [(key, f"{o:05d}", o, rng.randint(-5, 9)) for o in order]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("order", [["name"], ["num"], ["bucket", "num"]])
def test_running_equals_pandas(spark, policy, order):
    data = skewed(1)
    df = spark.createDataFrame(data, "k string, name string, num long, v long").withColumn(
        "bucket", F.expr("num div 1000")
    )
    got = running(
        df, ["k"], order, {"upto": F.col("v"), "no": F.lit(1)},
        after={"onward": F.col("v")}, previous={"prev": F.col("name")}, policy=policy,
    ).toPandas()
    want = pd.DataFrame(data, columns=["k", "name", "num", "v"]).sort_values(["k", "num"])
    group = want.groupby("k", dropna=False)
    want["upto"] = group["v"].cumsum()
    want["no"] = group.cumcount() + 1
    want["onward"] = group["v"].transform("sum") - want["upto"] + want["v"]
    want["prev"] = group["name"].shift()
    columns = ["k", "num", "upto", "no", "onward", "prev"]
    key = lambda d: d[columns].fillna("-").sort_values(["k", "num"]).values.tolist()
    assert key(got) == key(want)


def test_cuts_are_bounded_and_repeatable(spark):
    df = spark.createDataFrame(skewed(2), "k string, name string, num long, v long")
    cuts = {r["k"]: r["_cuts"] for r in hot_key_cuts(df, ["k"], ["num"], SPLIT_ALL).collect()}
    again = {r["k"]: r["_cuts"] for r in hot_key_cuts(df.repartition(7), ["k"], ["num"], SPLIT_ALL).collect()}
    assert cuts == again and len(cuts["hot"]) >= 2
    assert all(c == sorted(c) for c in cuts.values())
    few = hot_key_cuts(df, ["k"], ["num"], SplitPolicy(sample_mod=2, min_cuts=3, max_cuts=16))
    few = {r["k"]: len(r["_cuts"]) for r in few.collect()}
    assert set(few) == {"hot"} and 4 <= few["hot"] <= 40


def test_many_large_keys_are_all_cut_at_one_distance(spark):
    df = spark.range(600_000).select((F.col("id") % 1500).alias("k"), F.expr("id div 1500").alias("at"))
    policy = SplitPolicy(sample_mod=16, min_cuts=4)
    cuts = hot_key_cuts(df, ["k"], ["at"], policy).select("k", F.size("_cuts").alias("n"))
    assert cuts.count() > 1490  # 25 cuts each are expected
    low, mean, high = cuts.agg(F.min("n"), F.avg("n"), F.max("n")).first()
    assert 4 <= low and 24 < mean < 26 and high < 50  # equal order values of other keys do not fall together
    bounded = hot_key_cuts(df, ["k"], ["at"], SplitPolicy(sample_mod=16, min_cuts=1, max_cuts=3000))
    assert 2500 < bounded.agg(F.sum(F.size("_cuts"))).first()[0] < 3500
    assert running(df, ["k"], ["at"], {"no": F.lit(1)}, policy=policy).filter("no <> at + 1").count() == 0


def test_hot_key_is_spread_over_blocks(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("k"), "id")
    policy = SplitPolicy(sample_mod=16, min_cuts=4, max_cuts=64)
    out = running(df, ["k"], ["id"], {"no": F.lit(1)}, policy=policy)
    assert out.filter("no <> id + 1").count() == 0
    cuts = hot_key_cuts(df, ["k"], ["id"], policy).first()["_cuts"]
    widths = [b - a for a, b in zip([0, *cuts], [*cuts, 20_000])]
    assert max(widths) < 20_000 / 4


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_rows_in_spans(spark, width):
    df = spark.range(50).select(F.lit("a").alias("thread_id"), F.col("id").alias("position"))
    spans = spark.createDataFrame([("a", 3, 10), ("a", 10, 10), ("b", 0, 5), ("a", 49, 50)], "thread_id string, lo long, hi long")
    got = [r[1] for r in rows(rows_in_spans(df, spans, width=width), "thread_id", "position")]
    assert sorted(got) == [*range(3, 10), 49]
