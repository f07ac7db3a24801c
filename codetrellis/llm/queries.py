"""All queries of the subpackage: importing this module registers them."""

from __future__ import annotations

from codetrellis.llm import (  # noqa: F401
    chat_format,
    jaccard,
    merges,
    mixing,
    neighbours,
    packing,
    periodic,
    perplexity,
    prefix_trie,
    quality_rules,
    repeats,
    secrets,
    token_counts,
)
from codetrellis.llm.registry import QUERIES, SQL, query
import corpus_pipeline

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
__all__ = ["QUERIES", "SQL"]
