"""A corpus pipeline: ``run(spark, sf_dir)`` takes ``documents`` to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codetrellis.llm import stages
from codetrellis.llm.registry import table
from codetrellis.session import ensure_checkpoint_dir

STAGES = [
    ("quality classifier", stages.quality_classifier),
    ("near duplicates", stages.near_duplicates),
    ("secret scan", stages.secret_scan),
    ("source mixing", stages.source_mixing),
    ("best-fit packing", stages.best_fit_packing),
]

#: a language model and a tokenizer are not SQL; tests hold the stages against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
