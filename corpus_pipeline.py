"""From raw documents to training shards: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet in the shared folder and read back as the next stage's input. All stages
but the last give the columns of ``documents``.

1. quality: documents scored under 0.7 by the positive-unlabelled classifier go;
   all stay, with a warning, where the labels leave it nothing to learn from;
2. near duplicates: of each class of documents linked by a similarity of 0.8 or
   more, the one with the least id stays;
3. decontamination: documents that hold a window of a benchmark item go;
4. mixing: small sources are repeated, at most 1.25 times, to even out the
   mixture; the budget lets every document in at least once;
5. training order: token sequences in permuted order as fixed-stride shards; one
   row per sequence, with its documents.

A classifier and a tokenizer take part, so SQL cannot express the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatterloom.llm import decontaminate, jaccard, mixture, order, quality
from chatterloom.session import shared_folder, written

MOST_EPOCHS = 1.25


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels, skip=quality.held_out("doc_id", 4, 2))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.remove_documents(found).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs, cover=True, entropy=1.0, max_epochs=MOST_EPOCHS).select(*docs.columns)


def training_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order.ordered_rows(docs, shared_folder(spark, "order"))


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("temperature mixing", mixed),
    ("training order", training_order),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
