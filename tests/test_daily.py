import datetime as dt
import random
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

from chatterloom.operators.logs import newest_per_key
from chatterloom.sources import daily

START = dt.date(2024, 1, 1)


def make_log(spark, path, data):
    df = spark.createDataFrame(data, "day int, id string, op string, seq long, text string")
    df.select(F.expr("date_add(DATE'2024-01-01', day)").alias("dt"), "id", "op", "seq", "text").write.mode("append").partitionBy(
        "dt"
    ).parquet(path)


def files(path):
    return {p.parent.name: {f.name for f in p.parent.glob("*.parquet")} for p in Path(path).glob("dt=*/*.parquet")}


def folded(spark, path):
    return rows(newest_per_key(spark.read.parquet(path), ["id"], ["seq"]).filter("op <> 'delete'"), "id", "seq", "text")


def plain(data, share, since=None, until=None):
    newest = {}
    for day, key, _, seq, _ in data:
        if since is None or day >= since:
            newest[key] = max(newest.get(key, seq), seq)
    stale = lambda r: r[1] in newest and r[3] < newest[r[1]]
    by_day = {}
    for r in data:
        by_day.setdefault(r[0], []).append(r)
    days = {d for d, rs in by_day.items() if (n := sum(map(stale, rs))) and n >= share * len(rs) and (until is None or d < until)}
    return days, [r for r in data if r[0] not in days or not stale(r)]


@pytest.mark.parametrize("share, since, until", [(0.25, None, None), (0.6, None, 7), (0.1, 8, None)])
def test_days_are_compacted_as_a_loop_would(spark, tmp_path, share, since, until):
    rng = random.Random(int(share * 10))
    path, data = f"{tmp_path}/log", []
    for seq in range(400):
        day = seq // 40
        key = None if rng.random() < 0.05 else f"k{rng.randint(0, 300 if day % 2 else 20)}"
        data.append((day, key, "delete" if rng.random() < 0.1 else "put", seq, "x" * rng.randint(0, 9)))
    make_log(spark, path, data)
    before, kept = files(path), folded(spark, path)
    at = lambda d: None if d is None else START + dt.timedelta(d)
    days = daily.compact_days(spark, path, ["id"], least_share=share, since=at(since), until=at(until))
    want_days, want = plain(data, share, since, until)
    assert days and days == sorted(at(d) for d in want_days) and len(days) < 10
    spark.catalog.refreshByPath(path)
    assert rows(spark.read.parquet(path), "seq") == sorted(((r[3],) for r in want), key=repr)
    assert folded(spark, path) == kept
    after, rewritten = files(path), {f"dt={d}" for d in days}
    assert all(after[d] == before[d] for d in before if d not in rewritten)
    assert not any(after.get(d, set()) & before[d] for d in rewritten)
    if since is None and until is None:
        assert daily.compact_days(spark, path, ["id"], least_share=share) == []  # nothing left to do there


def test_a_day_out_of_date_as_a_whole_goes(spark, tmp_path):
    path = f"{tmp_path}/log"
    make_log(spark, path, [(0, "a", "put", 1, "old"), (1, "a", "put", 2, "new"), (1, "a", "put", 2, "same"), (2, "b", "delete", 3, None)])
    assert daily.compact_days(spark, path, ["id"]) == [START]
    assert rows(spark.read.parquet(path), "id", "seq") == [("a", 2), ("a", 2), ("b", 3)] and len(files(path)) == 2


def test_an_interrupted_replacement_can_be_repeated(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    make_log(spark, path, [(0, "a", "put", 1, "old"), (0, "b", "put", 1, "b"), (1, "a", "put", 2, "new")])
    want, put_back = folded(spark, path), daily.replace_days

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(daily, "replace_days", broken)
    with pytest.raises(daily.CompactionInterrupted) as failed:
        daily.compact_days(spark, path, ["id"])
    for _ in range(2):
        put_back(spark, path, failed.value.copy, failed.value.days)
    spark.catalog.refreshByPath(path)
    assert folded(spark, path) == want and spark.read.parquet(path).count() == 2
