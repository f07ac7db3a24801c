"""Words of a file that a glossary explains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.functions.rulebook import rules
from codetrellis.operators.lexing import tokens
from codetrellis.session import top_k
from codetrellis.sources.corpus import FILE_KEY, with_file_key


def glossary_hits(files: DataFrame, words: list[str] | None = None, limit: int = 6) -> DataFrame:
    """The first ``limit`` glossary words of each file in the order a reader meets them."""
    known = tokens(files).filter(F.col("text").isin(words or rules.GLOSSARY_WORDS))
    first = known.groupBy(*FILE_KEY, F.col("text").alias("word")).agg(F.min(F.struct("line", "pos")).alias("at"))
    listed = top_k(first, FILE_KEY, ["at"], limit, "place")
    owners = with_file_key(files).select(*FILE_KEY, "repo", "snap", "path")
    return listed.join(owners, FILE_KEY).select("repo", "snap", "path", "place", "word", F.col("at.line").alias("line"))
