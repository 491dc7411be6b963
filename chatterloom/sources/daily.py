"""Compaction of a log that is partitioned by day, day by day.

A log in which the newest row of a key decides (notes, summaries, sessions) fills with rows that
are out of date. ``compact_days`` drops them from the days where they make up a
good share, and leaves the files of all other days as they are. Folding the log gives the
same result before and after.

* Shares come from keys and order values only; texts move for chosen days alone.
* With ``since``, the days from it on are taken as what is new: older rows can only have
  been put out of date by their keys, so the older days are joined with those keys' newest rows
  instead of being folded again. That join is an equi-join against a side that is small next to
  the log, for which Spark filters the scan by a Bloom filter of the keys at run time.
* Deletes stay as rows, so that no older row of their key comes back.
* The kept rows are written to the shared folder first and go into the log by dynamic partition
  overwrite. If that is interrupted, ``CompactionInterrupted`` names the copy, and ``replace_days`` puts it in place again.
  One job compacts a log at a time, and days that still grow must be left out by ``until``.
* Equal rows (same key, same order values) count as one state: ties are kept, all of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.session import shared_folder

DAY = "dt"


class CompactionInterrupted(RuntimeError):
    def __init__(self, copy: str, days: list[dt.date]):
        super().__init__(f"days {days} may be missing; their rows are at {copy}: call replace_days with it")
        self.copy, self.days = copy, days


def _state(order: Sequence[str]):
    return F.struct(*order).alias("_state")


def _newest(log: DataFrame, keys: Sequence[str], order: Sequence[str], since: dt.date | None) -> DataFrame:
    """Newest state of each key that can put rows out of date; a key's rows are pre-aggregated before they move."""
    new = log if since is None else log.filter(F.col(DAY) >= F.lit(since))
    return new.select(*keys, _state(order)).groupBy(*keys).agg(F.max("_state").alias("_newest"))


def _same(keys: Sequence[str], left: DataFrame, right: DataFrame):
    return [left[k].eqNullSafe(right[k]) for k in keys]


def day_shares(log: DataFrame, keys: Sequence[str], order: Sequence[str], since: dt.date | None = None) -> DataFrame:
    """``dt, log_rows, out_of_date`` of every day."""
    narrow = log.select(DAY, *keys, _state(order))
    newest = _newest(log, keys, order, since)
    old = narrow.join(newest, _all(_same(keys, narrow, newest)), "inner").filter("_state < _newest")
    stale = old.groupBy(narrow[DAY]).agg(F.count(F.lit(1)).alias("out_of_date"))
    total = log.groupBy(DAY).agg(F.count(F.lit(1)).alias("log_rows"))
    return total.join(stale, DAY, "left").select(
        DAY, "log_rows", F.coalesce("out_of_date", F.lit(0).cast("bigint")).alias("out_of_date")
    )


def replace_days(spark: SparkSession, path: str, copy: str, days: Sequence[dt.date]) -> None:
    """Put copied days in place of the log's; may be repeated."""
    # Days without a kept row are not in the copy, so the overwrite leaves them; they go as a whole.
    left: set[dt.date] = set()
    try:
        rows = spark.read.parquet(copy)
    except AnalysisException as error:
        if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
    else:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
        left = {r[0] for r in rows.select(DAY).distinct().collect()}
    for day in set(days) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{DAY}={day.isoformat()}")
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def compact_days(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    order: Sequence[str] = ("seq",),
    least_share: float = 0.25,
    since: dt.date | None = None,
    until: dt.date | None = None,
) -> list[dt.date]:
    """Rewrite the days whose share of rows out of date is ``least_share`` or more; tells which.

    Rows without a day (a null time) stay as they are. An empty log has no days.
    """
    log = spark.read.parquet(path)
    shares = day_shares(log, keys, order, since).filter(F.col(DAY).isNotNull() & (F.col("out_of_date") > 0))
    if until is not None:
        shares = shares.filter(F.col(DAY) < F.lit(until))
    # One row per day of the log.
    days = sorted(r[0] for r in shares.filter(F.col("out_of_date") >= F.col("log_rows") * least_share).collect())
    if not days:
        return []
    chosen = log.filter(F.col(DAY).isin(days))
    marked, newest = chosen.withColumn("_state", _state(order)), _newest(log, keys, order, since)
    dead = [*_same(keys, marked, newest), marked["_state"] < newest["_newest"]]
    kept = marked.join(newest, _all(dead), "left_anti").drop("_state")
    copy = shared_folder(spark, "compacted-days")
    kept.hint("rebalance", DAY).write.partitionBy(DAY).parquet(copy)
    try:
        replace_days(spark, path, copy, days)
    except Exception as error:
        raise CompactionInterrupted(copy, days) from error
    folder = spark._jvm.org.apache.hadoop.fs.Path(copy)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    return days


def _all(conditions):
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
