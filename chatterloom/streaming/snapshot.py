"""A keyed table kept current by a stream: upserts and deletes as they arrive.

Rows are dealt to ``buckets`` by the hash of their key. A micro-batch N reads only the
buckets it touches, keeps the newest row of each key and writes those buckets
anew under ``batch_id=N``. A reader takes the latest finished version of every
bucket: there is no log to fold. The work of a micro-batch follows the buckets
it touches, and a bucket holds its share of the keys, however often a key is written.

* A batch counts once its folder has its success marker; one that failed halfway is not seen.
* A replayed batch starts from the versions before it and writes over its own, so it
  changes nothing. The version before the latest is kept for that, and for readers that have
  started; older ones are deleted.
* The newest row in ``order`` wins, whichever batch brings it; among equals, the later batch.
  Deletes stay as rows, so that an older put that arrives late stays dead; ``read`` leaves them out.
* One stream writes a table. Its number of buckets is fixed by its first batch.

The driver lists folders: two versions of each bucket at most, and the last batch's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chatterloom.operators.logs import newest_per_key

BUCKET, BATCH = "_bucket", "batch_id"


class KeyedSnapshot:
    def __init__(
        self, path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], *, buckets: int = 64,
        gone: Sequence[str] = ("delete", "remove"),
    ):
        self.path, self.schema, self.keys, self.order = path.rstrip("/"), schema, list(keys), list(order)
        self.buckets, self.gone = buckets, list(gone)

    # --- folders -----------------------------------------------------------------

    def _list(self, spark: SparkSession, folder: str, prefix: str) -> dict[int, str]:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(at):
            return {}
        names = [f.getPath().getName() for f in files.listStatus(at)]
        return {int(n.removeprefix(prefix)): f"{folder}/{n}" for n in names if n.startswith(prefix)}

    def _exists(self, spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)

    def _delete(self, spark: SparkSession, path: str) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)

    def _versions(self, spark: SparkSession, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
        """Finished versions (batch, folder) of every bucket, oldest first."""
        found: dict[int, list[tuple[int, str]]] = {}
        for batch, folder in sorted(self._list(spark, self.path, f"{BATCH}=").items()):
            if (before is None or batch < before) and self._exists(spark, f"{folder}/_SUCCESS"):
                for bucket, path in self._list(spark, folder, f"{BUCKET}=").items():
                    found.setdefault(bucket, []).append((batch, path))
        return found

    def _rows(self, spark: SparkSession, paths: Sequence[str]) -> DataFrame:
        if not paths:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*paths)

    def _check_buckets(self, spark: SparkSession) -> None:
        known = self._list(spark, self.path, "_buckets=")
        if known and set(known) != {self.buckets}:
            raise ValueError(f"{self.path} has {next(iter(known))} buckets, not {self.buckets}")
        if not known:
            at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_buckets={self.buckets}")
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).mkdirs(at)

    # --- use ---------------------------------------------------------------------

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """Write the buckets that a micro-batch touches."""
        spark = batch.sparkSession
        self._check_buckets(spark)
        rows = batch.select(*self.schema.names)
        # A micro-batch is read for its newest rows and for its buckets: keep it, narrowed to one row per key.
        newest = newest_per_key(rows, self.keys, self.order).persist()
        try:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).alias(BUCKET)
            touched = [r[0] for r in newest.select(bucket).distinct().collect()]  # at most ``buckets``
            versions = self._versions(spark, before=batch_id)
            base = self._rows(spark, [versions[b][-1][1] for b in touched if b in versions])
            both = base.withColumn("_gen", F.lit(0)).unionByName(newest.withColumn("_gen", F.lit(1)))
            merged = newest_per_key(both, self.keys, [*self.order, "_gen"]).drop("_gen").select("*", bucket)
            merged.hint("rebalance", BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{BATCH}={batch_id}")
        finally:
            newest.unpersist()
        for bucket_no in touched:
            for _, path in versions.get(bucket_no, [])[:-1]:
                self._delete(spark, path)
        for batch_no, folder in self._list(spark, self.path, f"{BATCH}=").items():
            if batch_no < batch_id and not self._list(spark, folder, f"{BUCKET}="):
                self._delete(spark, folder)

    def read(self, spark: SparkSession) -> DataFrame:
        """Current rows."""
        rows = self._rows(spark, [found[-1][1] for _, found in sorted(self._versions(spark).items())])
        return rows.filter(~F.col("op").isin(self.gone)).drop("op") if "op" in self.schema.names else rows


def upsert_batches(stream: DataFrame, snapshot: KeyedSnapshot, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Merge every micro-batch of a stream into a snapshot and stop at the end."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .foreachBatch(snapshot.merge).trigger(availableNow=True).start()
    )
