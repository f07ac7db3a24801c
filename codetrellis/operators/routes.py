"""Reading routes: entry point, steps, what lies beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrellis.functions import paths, scores
from codetrellis.functions.rulebook import rules
from codetrellis.operators.graph import hubs
from codetrellis.session import REPO_KEYS, brief, cut, top_k


def reading_nodes(symbols: DataFrame) -> DataFrame:
    """The columns a route needs, with readability and core directory decided once."""
    return symbols.select(
        *REPO_KEYS,
        "sym_id",
        "name",
        "path",
        "kind",
        "is_external",
        "fan_in",
        "fan_out",
        "span",
        F.coalesce(scores.is_readable(F.col("path"), F.col("kind"), F.col("is_external")), F.lit(False)).alias("readable"),
        F.coalesce(scores.in_core_directory(F.col("path")), F.lit(False)).alias("core"),
        F.coalesce(paths.dirname(F.col("path")), F.lit("")).alias("directory"),
    )


def entry_reach(nodes: DataFrame, edges: DataFrame, first: int = 12) -> DataFrame:
    """Capped reach of each node that calls something: its own fan-out and its first callees' (G8)."""
    callees = top_k(edges.select(*REPO_KEYS, "src", "dst"), REPO_KEYS + ["src"], ["dst"], first)
    ends = nodes.filter(~F.col("is_external")).select(
        *REPO_KEYS, F.col("sym_id").alias("dst"), F.least(F.lit(4), "fan_out").alias("_next")
    )
    beyond = callees.join(ends, REPO_KEYS + ["dst"]).groupBy(*REPO_KEYS, F.col("src").alias("sym_id")).agg(
        F.sum("_next").alias("_beyond")
    )
    return (
        nodes.filter("fan_out >= 1")
        .join(beyond, REPO_KEYS + ["sym_id"], "left")
        .withColumn(
            "entry_reach",
            F.least(
                F.lit(40), 2 * F.least(F.lit(10), F.col("fan_out")) + F.coalesce("_beyond", F.lit(0))
            ),
        )
        .drop("_beyond")
    )


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Where each program begins, as far as the graph can tell."""
    score = (
        F.col("entry_reach")
        + F.when(F.lower("name").isin(rules.ROUTE_ENTRY_NAMES), 120).otherwise(0)
        + F.when(F.col("fan_in") == 0, 45).otherwise(0)
        - F.when(F.col("fan_in") > 20, 50).otherwise(0)
        + F.when(F.col("core"), 20).otherwise(0)
        - F.when(F.col("span") < 4, 15).otherwise(0)
    )
    scored = entry_reach(nodes, edges).filter("readable").withColumn("entry_score", score)
    return top_k(scored, REPO_KEYS, [F.col("entry_score").desc(), "sym_id"], 1).drop("rank")


def step_score(previous_directory: Column) -> Column:
    """Leads somewhere and is worth reading; both halves are capped."""
    fan_in, fan_out = F.col("fan_in"), F.col("fan_out")
    return (
        4 * F.least(F.lit(12), fan_out)
        + F.least(F.lit(6), fan_in)
        + F.when(F.col("span") >= 6, 6).otherwise(-10)
        - F.when(fan_out == 0, 25).otherwise(0)
        - F.when(fan_in > 40, 30).otherwise(0)
        + F.when(F.col("core"), 12).otherwise(0)
        + F.when(F.col("directory") == previous_directory, 8).otherwise(0)
        - F.when(F.col("kind") == "initializer", 4).otherwise(0)
    )


def route(symbols: DataFrame, edges: DataFrame, max_steps: int = 6, min_steps: int = 4) -> DataFrame:
    """``(repo, snap, step, sym_id, reached_from)``: a path to read each program along.

    From the entry point to the best unvisited callee, round by round for all
    repositories. A route shorter than ``min_steps`` is widened with other
    callees of its entry point.
    """
    nodes = cut(reading_nodes(symbols))
    step = edges.select(*REPO_KEYS, "src", "dst")
    target = nodes.filter("readable").drop("readable").withColumnRenamed("sym_id", "dst")
    start = cut(
        entry_points(nodes, edges).select(
            *REPO_KEYS, F.lit(1).alias("step"), "sym_id", F.lit(None).cast("bigint").alias("reached_from"), "directory"
        )
    )
    steps = [start]

    def visited() -> DataFrame:
        parts = [part.select(*REPO_KEYS, F.col("sym_id").alias("dst")) for part in steps]
        return reduce(DataFrame.unionByName, parts)

    def callees(current: DataFrame) -> DataFrame:
        # a row for each repository against all edges
        from_here = brief(current.select(*REPO_KEYS, F.col("sym_id").alias("src"), F.col("directory").alias("_from")))
        return (
            step.join(from_here, REPO_KEYS + ["src"])
            .join(visited(), REPO_KEYS + ["dst"], "left_anti")
            .join(target, REPO_KEYS + ["dst"])
            .withColumn("_score", step_score(F.col("_from")))
        )

    for number in range(2, max_steps + 1):
        options = callees(steps[-1])
        if number < max_steps:
            options = options.filter("fan_out > 0")
        best = cut(
            top_k(options, REPO_KEYS, [F.col("_score").desc(), "dst"], 1).select(
                *REPO_KEYS,
                F.lit(number).alias("step"),
                F.col("dst").alias("sym_id"),
                F.col("src").alias("reached_from"),
                "directory",
            )
        )
        if best.isEmpty():
            break
        steps.append(best)
    walked = reduce(DataFrame.unionByName, steps)
    lengths = walked.groupBy(*REPO_KEYS).agg(F.max("step").alias("_steps")).filter(F.col("_steps") < min_steps)
    spare = callees(cut(start.join(lengths, REPO_KEYS, "left_semi")))
    ranked = top_k(spare, REPO_KEYS, [F.col("_score").desc(), "dst"], max_steps)
    widened = (
        ranked.join(lengths, REPO_KEYS)
        .withColumn("step", (F.col("_steps") + F.col("rank")).cast("int"))
        .filter(F.col("step") <= max_steps)
        .select(*REPO_KEYS, "step", F.col("dst").alias("sym_id"), F.col("src").alias("reached_from"))
    )
    return walked.drop("directory").unionByName(widened)


def hubs_elsewhere(symbols: DataFrame, steps: DataFrame, consider: int = 14, show: int = 8) -> DataFrame:
    """Most-called symbols that are not on the route."""
    top = hubs(symbols, REPO_KEYS, consider, "sym_id").drop("rank")
    others = top.join(steps.select(*REPO_KEYS, "sym_id"), REPO_KEYS + ["sym_id"], "left_anti")
    return top_k(others, REPO_KEYS, [F.col("fan_in").desc(), "sym_id"], show)


def route_progress(symbols: DataFrame, steps: DataFrame, marks: DataFrame) -> DataFrame:
    """Steps in all and steps marked as understood per repository.

    ``marks`` is ``(repo, signature)`` and outlives a scan.
    """
    signed = steps.join(symbols, REPO_KEYS + ["sym_id"]).withColumn(
        "signature", scores.signature(F.col("path"), F.col("display"), F.col("line"))
    )
    known = marks.select("repo", "signature").distinct().withColumn("_known", F.lit(True))
    return signed.join(known, ["repo", "signature"], "left").groupBy(*REPO_KEYS).agg(
        F.count(F.lit(1)).alias("steps"), F.count("_known").alias("understood")
    )
