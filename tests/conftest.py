import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def corpus_of(spark):
    """Files of one repository from a mapping of path to text."""
    from codetrellis.sources.corpus import read_corpus

    def build(texts, repo="r", **options):
        rows = [(repo, "a", path, text) for path, text in texts.items()]
        raw = spark.createDataFrame(rows, "repo string, snap string, path string, content string")
        return read_corpus(raw, **options)

    return build
