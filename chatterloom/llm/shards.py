"""Proportional stratified interleaving: every shard holds the source mixture.

Rows of each source are ranked in a seeded random order; a row of rank r among n
gets the fractional rank (r + 1/2) / n, all rows are sorted by it, and the sorted
sequence is cut into runs of equal length. Any run holds each source in
proportion, to within one row per source.

No source and no table is ranked in one task. For the ranks, rows of a source fall into
buckets by the top bits of their hash, about ``bucket_rows`` rows each. For the sort, ranges of
all sort keys are cut at sampled rows, so rows of equal fractional rank, as those of very
many tiny sources, are cut too. Counts of buckets and ranges supply what came before; only
they are summed in one task.

Defined cases: rows without a source form a source; a null text has size 1 and
the checksum of the empty text; repeated rows take neighbouring ranks; ties in
the fractional rank go by source, then hash, key and checksum. Texts and other
columns do not move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterloom.session import written

HASH_BITS = 60


def seeded_hash(seed: str, *values: Column) -> Column:
    """60 random bits, the same in any engine that has MD5."""
    parts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *parts)), 1, 15), 16, 10).cast("bigint")


def _numbered(df: DataFrame, keys: list[str], bucket: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with its 0-based row number per ``keys`` in bucket order, and the rows per key as ``_n``."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_c"))
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("_c").over(across.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = counts.select(*keys, bucket, (before - F.col("_c")).alias("_before"), F.sum("_c").over(across).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)) - 1
    return df.withColumn("_at", inside).join(offsets, [*keys, bucket]).withColumn(name, F.col("_before") + F.col("_at")).drop("_at", "_before", bucket)


def _positions(df: DataFrame, order: list[Column], ranges: int) -> DataFrame:
    """``df`` with its 0-based place in ``order``: sorted ranges are written with the number of each row in its range."""
    number = F.monotonically_increasing_id()  # the range in the upper 31 bits, the row's place in the range in the others
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", number)
    rows = written(rows.withColumn("_b", F.expr("shiftright(_id, 33)")), "ranges")
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = counts.select("_b", (upto - F.col("_c")).alias("_before"))
    return rows.join(before, "_b").withColumn("_pos", F.col("_before") + F.expr(f"_id & {(1 << 33) - 1}"))


def stratified_shards(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    shards: int = 16,
    seed: str = "shards",
    bucket_rows: int = 65_536,
) -> DataFrame:
    """``key, source, size, text_crc32, shard, slot`` for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    crc = F.crc32(F.encode(body, "UTF-8"))
    slim = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("_s"), F.col(source).isNull().alias("_none"),
        (F.octet_length(body) + 1).cast("bigint").alias("size"), crc.alias("_crc"), seeded_hash(seed, F.col(key), crc).alias("_h"),
    )
    slim = written(slim, "strata")
    total = slim.count()
    bits = max(0, (total // bucket_rows).bit_length())
    order = [F.col("_h"), F.col("_key"), F.col("_crc")]
    top = F.expr(f"shiftright(_h, {HASH_BITS - bits})")
    ranked = _numbered(slim.withColumn("_b", top), ["_none", "_s"], "_b", order, "_rank")
    ranked = ranked.withColumn("_frac", (F.col("_rank") + 0.5) / F.col("_n")).drop("_rank", "_n")
    placed = _positions(written(ranked, "ranks"), [F.col("_frac"), F.desc("_none"), F.col("_s"), *order], total // bucket_rows + 1)
    shard = F.expr(f"_pos * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_key").alias(key),
        F.when(~F.col("_none"), F.col("_s")).alias(source),
        "size",
        F.col("_crc").alias("text_crc32"),
        shard.cast("int").alias("shard"),
        "_pos",
    ).withColumn("slot", F.col("_pos") - first).drop("_pos")
