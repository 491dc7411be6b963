"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "chatterloom") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for stream checkpoints and written tables.

    It lies under ``spark.checkpoint.dir``, which every executor can reach. Only
    a local master may fall back to a machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/chatterloom/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="chatterloom-"), name)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table written to the shared folder.

    Used where a shuffled result feeds several branches: it is computed once,
    its lineage ends there, and a lost executor costs a re-read. The table is
    deleted at the end of a ``scratch`` block, or else when the application ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    _files(spark, folder).deleteOnExit(folder)
    for made in _open_blocks:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


_open_blocks: list[list[str]] = []


def _files(spark: SparkSession, folder):
    return folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what ``written`` made inside; store or collect results before that."""
    made: list[str] = []
    _open_blocks.append(made)
    try:
        yield
    finally:
        _open_blocks.remove(made)
        for path in made:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            _files(spark, folder).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Make the library importable on executors, wherever the driver was started.

    Functions are pickled by module reference, so workers must be able to import
    the package: it goes to them as a zip file, once per Spark application.
    """
    context = spark.sparkContext
    if getattr(context, "_chatterloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="chatterloom-"), "chatterloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(archive)
    context._chatterloom_shipped = True
