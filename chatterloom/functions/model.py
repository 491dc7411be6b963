"""A user's text-to-text function over a column: the only Python in batch executors.

Answers can be kept in a store, a folder of Parquet files keyed by the digest of
the prompt. Each task then asks one call's worth of prompts that the store lacks, and
its answers stay when it is done, whatever becomes of the job: files of finished tasks go
straight to their place (the second version of Hadoop's commit algorithm). So
a retried task repeats its own call at most, and a run after a failure, or another run
over prompts that were asked before, asks only what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterloom.session import ship_package

TextFunction = Callable[[pd.Series], pd.Series]
CALL_ROWS = 1024
_ANSWERS = "digest string, answer string"


def apply_text_function(
    df: DataFrame, function: TextFunction, *, answers: str | None = None, model: str = "", call_rows: int = CALL_ROWS
) -> DataFrame:
    """Replace ``text`` where ``due`` is true; each Arrow batch is one call.

    With ``answers``, a folder that all executors share, every prompt is asked once per
    ``model``, in calls of about ``call_rows`` prompts, and equal prompts get one answer.
    """
    ship_package(df.sparkSession)
    if answers is not None:
        return _from_store(df, function, answers, model, call_rows)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch["due"].any():
                batch.loc[batch["due"], "text"] = function(batch.loc[batch["due"], "text"])
            yield batch

    return df.mapInPandas(each, df.schema)


def stored_answers(df: DataFrame, answers: str) -> DataFrame:
    """``digest, answer`` of all finished calls."""
    try:
        found = df.sparkSession.read.schema(_ANSWERS).parquet(answers)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return df.sparkSession.createDataFrame([], _ANSWERS)
    # Two runs at once may both ask a prompt: the least answer counts, for all readers.
    return found.groupBy("digest").agg(F.min("answer").alias("answer"))


def _from_store(df: DataFrame, function: TextFunction, answers: str, model: str, call_rows: int) -> DataFrame:
    kept = df.columns
    digest = F.sha2(F.concat(F.lit(model), F.lit("\n"), F.coalesce("text", F.lit(""))), 256)
    keyed = df.withColumn("_digest", F.when(F.col("due"), digest))
    asked = keyed.filter("due").select(F.col("_digest").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    missing = asked.join(stored_answers(df, answers), "digest", "left_anti").dropDuplicates(["digest"])

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"digest": batch["digest"], "answer": function(batch["text"])})

    calls = missing.count() // call_rows + 1
    told = missing.repartition(calls, "digest").mapInPandas(ask, _ANSWERS)
    told.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(answers)
    known = stored_answers(df, answers).withColumnRenamed("digest", "_digest")
    text = F.when(F.col("due"), F.col("answer")).otherwise(F.col("text"))
    return keyed.join(known, "_digest", "left").select(*[text.alias(c) if c == "text" else c for c in kept])
