"""Where to start, project kind and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import scores
from codetrellis.functions.rulebook import rules
from codetrellis.operators.graph import hubs
from codetrellis.session import REPO_KEYS, top_k


def starting_points(symbols: DataFrame, limit: int = 8) -> DataFrame:
    """Functions that reach the most of a project, entry-like names first."""
    low = F.lower("path")
    kept = symbols.filter(
        ~F.col("is_external")
        & scores.is_callable(F.col("kind"))
        & ~low.contains("test")
        & ~low.contains("spec")
        & (F.col("fan_out") >= 2)
    )
    score = (
        F.col("fan_out")
        + F.when(F.lower("name").isin(rules.STARTING_NAMES), 40).otherwise(0)
        + F.when(F.col("fan_in") == 0, 12).otherwise(0)
        + F.when(F.col("span") > 12, 4).otherwise(0)
    )
    order = [F.col("start_score").desc(), F.col("fan_out").desc(), "sym_id"]
    return top_k(kept.withColumn("start_score", score), REPO_KEYS, order, limit)


def project_kinds(files: DataFrame, symbols: DataFrame, max_files: int | None = 400, max_hubs: int | None = 30) -> DataFrame:
    """What kind of program each repository is.

    Evidence: the first paths and the most-called names. A kind scores the
    number of its words that occur; at least two are needed.
    """
    shown = top_k(files.select(*REPO_KEYS, "path"), REPO_KEYS, ["path"], max_files).select(
        *REPO_KEYS, F.lower("path").alias("text")
    )
    called = hubs(symbols, REPO_KEYS, max_hubs, "sym_id").select(*REPO_KEYS, F.lower("name").alias("text"))
    table = [
        F.struct(F.lit(-place).alias("order"), F.lit(kind).alias("kind"), F.lit(word).alias("word"))
        for place, (kind, words) in enumerate(rules.PROJECT_KINDS)
        for word in words
    ]
    text = F.col("text")
    seen = (
        shown.unionByName(called)
        .select(*REPO_KEYS, F.explode(F.filter(F.array(*table), lambda w: text.contains(w["word"]))).alias("w"))
        .select(*REPO_KEYS, "w.*")
        .distinct()
        .groupBy(*REPO_KEYS, "kind", "order")
        .agg(F.count(F.lit(1)).alias("hits"))
    )
    best = seen.groupBy(*REPO_KEYS).agg(F.max(F.struct("hits", "order", "kind")).alias("b"))
    return (
        files.select(*REPO_KEYS)
        .distinct()
        .join(best, REPO_KEYS, "left")
        .select(
            *REPO_KEYS,
            F.when(F.col("b.hits") >= 2, F.col("b.kind")).otherwise(rules.DEFAULT_PROJECT_KIND).alias("project_kind"),
        )
    )


def language_counts(files: DataFrame) -> DataFrame:
    """Files per language (A3)."""
    return files.groupBy(*REPO_KEYS, "language").agg(F.count(F.lit(1)).alias("files"))


def top_languages(files: DataFrame, limit: int | None = 3) -> DataFrame:
    """Languages with the most files; ties in name order."""
    return top_k(language_counts(files), REPO_KEYS, [F.col("files").desc(), "language"], limit)


def project_figures(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Files, lines, symbols, edges and readable symbols per repository."""
    own = files.groupBy(*REPO_KEYS).agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").cast("bigint").alias("lines")
    )
    named = symbols.groupBy(*REPO_KEYS).agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(~F.col("is_external") & scores.is_callable(F.col("kind"))).alias("readable"),
    )
    calls = edges.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("connections"))
    return (
        own.join(named, REPO_KEYS, "left")
        .join(calls, REPO_KEYS, "left")
        .fillna(0, ["symbols", "readable", "connections"])
    )


def project_summary(
    files: DataFrame,
    symbols: DataFrame,
    edges: DataFrame,
    findings: DataFrame,
    progress: DataFrame | None = None,
    max_files: int | None = 400,
    max_hubs: int | None = 30,
) -> DataFrame:
    """One row per repository: figures, kind, top hubs, languages, findings, route (K4).

    ``max_files`` and ``max_hubs`` bound the evidence of the kind, as in ``project_kinds``.
    """
    top = hubs(symbols, REPO_KEYS, 3, "sym_id")
    top_hubs = top.groupBy(*REPO_KEYS).agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.struct("rank", F.col("display").alias("name"), F.col("fan_in").alias("callers")))
            ),
            lambda h: F.struct(h["name"].alias("name"), h["callers"].alias("callers")),
        ).alias("top_hubs")
    )
    languages = top_languages(files).groupBy(*REPO_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("rank", "language"))).getField("language").alias("languages")
    )
    issues = findings.groupBy(*REPO_KEYS).agg(
        F.count(F.lit(1)).alias("issue_count"), F.count_if(F.col("severity") == 2).alias("high_issue_count")
    )
    summary = (
        project_figures(files, symbols, edges)
        .join(project_kinds(files, symbols, max_files, max_hubs), REPO_KEYS, "left")
        .join(top_hubs, REPO_KEYS, "left")
        .join(languages, REPO_KEYS, "left")
        .join(issues, REPO_KEYS, "left")
    )
    if progress is not None:
        summary = summary.join(
            progress.withColumnsRenamed({"steps": "route_steps", "understood": "route_done"}), REPO_KEYS, "left"
        ).fillna(0, ["route_steps", "route_done"])
    return summary.fillna(0, ["issue_count", "high_issue_count"])
