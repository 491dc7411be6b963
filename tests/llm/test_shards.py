import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from chatterloom.llm import shards as S
from chatterloom.llm.shards import stratified_shards


def corpus(spark):
    rows = [(i, f"text {i}" * (i % 4), ("hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None), 1) for i in range(3000)]
    rows += [(5, None, "hot", 2), (5, None, "hot", 2), (None, "é" * 40_000, "lone", 3), (None, "", "hot", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(3)


def test_shards_match_the_mixture(spark):
    docs = corpus(spark)
    out = stratified_shards(docs, bucket_rows=50).collect()
    whole = Counter(r.source for r in docs.collect())
    assert Counter(r.source for r in out) == whole
    by_shard = defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r)
    sizes = [len(by_shard[k]) for k in range(16)]
    assert max(sizes) - min(sizes) <= 1 and len(by_shard) == 16
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
        for source, n in Counter(r.source for r in rows).items():
            assert abs(n - whole[source] / 16) <= 2
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want


def test_buckets_change_nothing(spark):
    key = lambda r: (str(r.doc_id), r.text_crc32, r.shard, r.slot)
    one, many = (sorted(map(key, stratified_shards(corpus(spark), bucket_rows=n).collect())) for n in (10**6, 20))
    assert one == many


def test_few_and_no_rows(spark):
    docs = corpus(spark)
    assert stratified_shards(docs.limit(0)).count() == 0
    three = stratified_shards(docs.filter("doc_id < 3")).collect()
    assert sorted(r.slot for r in three) == [0, 0, 0] and len({r.shard for r in three}) == 3


def test_ranges_are_bounded_when_every_source_has_one_row(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('s', id) AS source", "'t' AS text")
    out = S.stratified_shards(docs, bucket_rows=500).collect()
    assert len({(r.shard, r.slot) for r in out}) == 20_000
    frame = docs.selectExpr("doc_id", "0.5D AS _frac", "source AS _s")
    placed = S._positions(frame, [F.col("_frac"), F.col("_s")], 41)
    sizes = placed.groupBy("_b").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] < 1500 and sizes[1] > 30
    names = [r._s for r in placed.orderBy("_pos").collect()]
    assert names == sorted(names) and [r._pos for r in placed.orderBy("_pos").collect()] == list(range(20_000))
