"""Edges and nodes of any dependency graph.

Every function takes the columns that name a graph (``keys``); all graphs of a
table are worked on together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.session import top_k


def fold_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, src, dst, n)`` summed per pair, self-edges dropped (A1)."""
    n = F.col("n") if "n" in edges.columns else F.lit(1)
    return (
        edges.filter("src <> dst")
        .groupBy(*keys, "src", "dst")
        .agg(F.sum(n).cast("bigint").alias("n"))
    )


def degrees(edges: DataFrame, keys: list[str], node: str = "id") -> DataFrame:
    """``fan_in`` and ``fan_out``: distinct neighbours of every node on an edge (A2)."""
    ends = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("src").alias(node), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("dst").alias(node), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("e"),
    )
    return ends.groupBy(*keys, F.col(f"e.{node}").alias(node)).agg(
        F.sum("e.i").cast("bigint").alias("fan_in"), F.sum("e.o").cast("bigint").alias("fan_out")
    )


def with_degrees(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str = "id") -> DataFrame:
    """All nodes with their degrees, zero where there is no edge."""
    joined = nodes.drop("fan_in", "fan_out").join(degrees(edges, keys, node), keys + [node], "left")
    return joined.fillna(0, ["fan_in", "fan_out"])


def hubs(nodes: DataFrame, keys: list[str], limit: int = 12, node: str = "id") -> DataFrame:
    """The ``limit`` most-called nodes per graph; those nobody calls drop out after the cut."""
    inside = nodes.filter(~F.col("is_external")) if "is_external" in nodes.columns else nodes
    ranked = top_k(inside, keys, [F.col("fan_in").desc(), F.col(node)], limit)
    return ranked.filter("fan_in > 0")


def roots(nodes: DataFrame) -> DataFrame:
    """Callables of the project that nothing calls."""
    kept = nodes.filter("fan_in = 0")
    if "is_external" in nodes.columns:
        kept = kept.filter(~F.col("is_external"))
    if "kind" in nodes.columns:
        kept = kept.filter("kind <> 'type'")
    return kept


def neighbours(edges: DataFrame, keys: list[str], limit: int = 5) -> DataFrame:
    """First ``limit`` callers and callees of every node and how many are hidden.

    One row per listed neighbour: side, place (1-based), other, hidden.
    """
    sides = edges.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col("dst").alias("id"), F.lit("caller").alias("side"), F.col("src").alias("other")),
                F.struct(F.col("src").alias("id"), F.lit("callee").alias("side"), F.col("dst").alias("other")),
            )
        ).alias("e"),
    ).select(*keys, "e.*")
    totals = sides.groupBy(*keys, "id", "side").agg(F.count(F.lit(1)).alias("total"))
    listed = top_k(sides, keys + ["id", "side"], ["other"], limit, "place")
    return listed.join(totals, keys + ["id", "side"]).select(
        *keys,
        "id",
        "side",
        "place",
        "other",
        F.greatest(F.lit(0), F.col("total") - limit).cast("bigint").alias("hidden"),
    )


def reciprocal_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that depend on each other, each once with the smaller end first."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.filter("src < dst").join(back, keys + ["src", "dst"], "left_semi").select(*keys, "src", "dst")


def fan_bars(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Out-degree as a share of the largest of the graph."""
    largest = nodes.groupBy(*keys).agg(F.max("fan_out").alias("_largest"))
    return (
        nodes.join(largest, keys)
        .withColumn("fan_share", F.col("fan_out") / F.greatest(F.col("_largest"), F.lit(1)))
        .drop("_largest")
    )
