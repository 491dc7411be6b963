"""Reading and writing the stored tables, and the read-only SQL console."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatterloom.config import CONSOLE_DEFAULT_QUERY
from chatterloom.operators.logs import newest_per_key
from chatterloom.schemas import COLUMN_DEFAULTS, TABLES
from chatterloom.sources.console import refusal


def evolve_schema(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add missing columns, and fill missing values, with their defaults."""
    filled = {
        name: F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
        for name, value in defaults.items()
    }
    return df.withColumns(filled)


def load_tables(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None, views: bool = True
) -> dict[str, DataFrame]:
    """Stored tables with their declared schemas and defaults, as temp views.

    Without ``names``, tables that are not in the directory are left out.
    """
    found: dict[str, DataFrame] = {}
    for name in names or TABLES:
        try:
            df = spark.read.schema(TABLES[name]).parquet(f"{directory}/{name}")
        except AnalysisException as error:
            if names is None and error.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        found[name] = evolve_schema(df, COLUMN_DEFAULTS.get(name, {}))
        if views:
            found[name].createOrReplaceTempView(name)
    return found


def register_views(tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def append_log(
    df: DataFrame, path: str, time_column: str = "ts", id_column: str | None = None
) -> None:
    """Append rows, partitioned by day; missing ids and times are generated.

    Rows are clustered by day first, so each day gets a few large files instead
    of one per task; a heavy day is still split by adaptive rebalancing.
    """
    if id_column and id_column not in df.columns:
        df = df.withColumn(id_column, F.expr("uuid()"))
    now = F.current_timestamp()
    stamp = F.coalesce(F.col(time_column), now) if time_column in df.columns else now
    dated = df.withColumn(time_column, stamp).withColumn("dt", F.to_date(time_column))
    dated.hint("rebalance", "dt").write.mode("append").partitionBy("dt").parquet(path)


def compact_log(
    log: DataFrame, keys: Sequence[str], out: str, order: str = "seq", drop_ops: Sequence[str] = ("delete", "remove")
) -> None:
    """Write only the current row of each key to a new directory.

    For logs in which the last event of a key decides (notes, summaries). The
    source is not touched, so readers move over once the write is complete.
    """
    current = newest_per_key(log, keys, [order])
    live = current.filter(~F.col("op").isin(*drop_ops)) if "op" in log.columns else current
    live.hint("rebalance", *keys).write.mode("errorifexists").parquet(out)


def write_table(df: DataFrame, path: str) -> None:
    """Write a complete snapshot to a new directory."""
    df.write.mode("errorifexists").parquet(path)


def run_readonly_sql(
    spark: SparkSession, text: str = CONSOLE_DEFAULT_QUERY, write_mode: bool = False
) -> DataFrame:
    """Ad-hoc SQL over the registered views; only reading statements by default."""
    statement = text.strip().rstrip(";").strip()
    why = None if write_mode else refusal(spark, statement)
    if why:
        raise PermissionError(f"only reading statements are allowed without write mode: {why}")
    return spark.sql(statement)
