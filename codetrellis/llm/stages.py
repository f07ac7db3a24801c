"""The operators as stages of a corpus pipeline: documents in, documents out.

A stage returns the columns it got. Decisions are made on narrow tables and meet
the texts in one join by ``doc_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.llm.jaccard import Join, near_groups, with_fingerprints
from codetrellis.llm.mixing import mixed_documents
from codetrellis.llm.packing import pack
from codetrellis.llm.perplexity import classify, toxic_ids, trusted_ids
from codetrellis.llm.registry import table
from codetrellis.llm.secrets import redacted, scan
from codetrellis.session import checkpointed as cut


#: ids up to which a list of documents to drop is broadcast; a longer one is joined by shuffle
BROADCAST_IDS = 1_000_000


def _free(name: str, taken: list[str]) -> str:
    """``name``, or the first of its kind that no column has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``gone(_gone)``; null matches null."""
    gone = cut(gone)
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the models of trusted and of toxic text reject.

    Rows that share a doc_id, or have none, share the verdict: they stay if one of them does.
    """
    labels = table(spark, sf_dir, "labels")
    verdicts = classify(docs, trusted_ids(labels), toxic=toxic_ids(labels))
    gone = verdicts.groupBy(F.col("doc_id").alias("_gone")).agg(F.max("kept").alias("_kept")).filter("NOT _kept")
    return _without(docs, gone.select("_gone"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near copies.

    Five-word shingles, similarity 0.8 or more. Texts without words stay, as do rows without a
    doc_id. A row repeated with its doc_id and text stays once. Different texts that share a
    doc_id are decided each by its own set; where their id is the smallest of a group they stay.
    """
    join = Join(width=5, num=80, den=100)
    groups = cut(near_groups(docs, join, names=True))
    first = F.col("component_id") == F.col("doc_id")
    told = groups.groupBy(F.col("doc_id").alias("_id")).agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    told = cut(told.filter("NOT _first OR _rows > 1"))
    if told.filter("_rows > 1").isEmpty():  # no id repeats: one pass over the texts is enough
        return _without(docs, told.select(F.col("_id").alias("_gone")))
    again = told.filter("_rows > 1").select(F.col("_id").alias("_again"))
    twice = docs.join(again, docs["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    named = groups.join(again, groups["doc_id"] == again["_again"], "left_semi").filter(first)
    named = named.select(F.col("doc_id").alias("_id"), F.col("f1").alias("_g1"), F.col("f2").alias("_g2")).distinct()
    f1, f2 = _free("_f1", docs.columns), _free("_f2", docs.columns)
    twice = with_fingerprints(twice, join, (f1, f2))
    same = (twice["doc_id"] == named["_id"]) & (twice[f1] == named["_g1"]) & (twice[f2] == named["_g2"])
    kept = twice.join(named, same, "left_semi").drop(f1, f2)
    return _without(docs, told.select(F.col("_id").alias("_gone"))).unionByName(kept)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts by a mark; documents without one stay as they are."""
    spans = _free("_secrets", docs.columns)
    found = scan(docs, out=spans)
    hit = F.size(spans) > 0
    changed = found.withColumn("text", F.when(hit, redacted(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*[F.col(f"`{c}`") for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents drawn for the target weights of sources, languages and forms."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"), "doc_id", "text", "source", "lang"
    )
    drawn = mixed_documents(rows).filter("_chosen").select("_whole")
    return drawn.select(*[F.col("_whole")[c].alias(c) for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    return pack(docs)
