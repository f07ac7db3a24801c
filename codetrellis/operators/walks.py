"""Graph walks for all graphs and all starting points at once.

Each round joins the frontier to the edges and drops what was seen. A round's
result is checkpointed, so neither lineage nor plan grows with the rounds, and
a lost executor costs at most one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetrellis.session import cut


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reversed_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))


def expand(
    edges: DataFrame,
    sources: DataFrame,
    keys: list[str],
    max_hops: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Breadth-first search from every source: ``(keys, source, node, hop)``.

    The source itself is hop 0. With ``limit`` a source stops before the node
    at which ``limit`` nodes are already seen; the last node expanded may
    overshoot. Nodes are taken in (parent, id) order, so capped results are
    exact as well.
    """
    step = cut(edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    who = keys + ["source"]
    start = cut(
        sources.select(*who)
        .distinct()
        .withColumn("node", F.col("source"))
        .withColumn("hop", F.lit(0))
        .withColumn("place", F.lit(1))
    )
    seen = [start]
    frontier = start
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        visited = _union([part.select(*who, "node") for part in seen])
        reached = (
            frontier.join(step, keys + ["node"])
            .groupBy(*who, F.col("next").alias("node"))
            .agg(F.min("place").alias("parent"))
            .join(visited, who + ["node"], "left_anti")
        )
        if limit is not None:
            reached = cut(reached)
            sizes = visited.groupBy(*who).agg(F.count(F.lit(1)).alias("_seen"))
            # at most one row per expanded node of a source, and fewer than limit of those
            earlier = Window.partitionBy(*who).orderBy("parent").rowsBetween(Window.unboundedPreceding, -1)
            allowed = (
                reached.groupBy(*who, "parent")
                .agg(F.count(F.lit(1)).alias("_new"))
                .withColumn("_before", F.coalesce(F.sum("_new").over(earlier), F.lit(0)))
                .join(sizes, who)
                .filter(F.col("_seen") + F.col("_before") < limit)
                .select(*who, "parent")
            )
            reached = reached.join(allowed, who + ["parent"], "left_semi")
        found = cut(reached.withColumn("hop", F.lit(hop)))
        if found.isEmpty():
            break
        if limit is None:
            frontier = found.withColumn("place", F.lit(1))
        else:
            # only sources still below the limit go on, so a window holds fewer than limit rows
            totals = (
                _union([part.select(*who) for part in seen + [found]])
                .groupBy(*who)
                .agg(F.count(F.lit(1)).alias("_total"))
                .filter(F.col("_total") < limit)
            )
            order = Window.partitionBy(*who).orderBy("parent", "node")
            frontier = found.join(totals, who, "left_semi").withColumn("place", F.row_number().over(order))
        seen.append(found)
        if len(seen) > 12:
            seen = [cut(_union([part.select(*who, "node", "hop") for part in seen]))]
    return _union([part.select(*who, "node", "hop") for part in seen])


# rounds in which sets of nodes below others are made, from the ends of a graph upwards
_UPWARDS = 64


def _small_sets(edges: DataFrame, sources: DataFrame, keys: list[str], limit: int) -> DataFrame | None:
    """``(keys, source, reach)`` of nodes that reach fewer than ``limit - 1`` others and no cycle.

    Nodes that lead nowhere come first; a node follows when all that it leads to have come, with the union
    of their sets, so a set goes once along every edge that enters its node. A set has fewer than
    ``limit`` nodes, a node is given as many at most. None if few of the graph's nodes are sources.
    """
    names = [F.col(k).isNotNull() for k in keys + ["node"]]
    known = reduce(lambda a, b: a & b, names)
    step = cut(
        edges.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"))
        # an edge without an end keeps its start open
        .filter(known & (F.col("next").isNull() | (F.col("node") != F.col("next")))).distinct()
    )
    asked = sources.select(*keys, F.col("source").alias("node")).filter(known).distinct()
    ends = step.select(*keys, "node").unionByName(step.select(*keys, F.col("next").alias("node")).filter(known))
    nodes = cut(asked.withColumn("_asked", F.lit(1)).unionByName(ends.withColumn("_asked", F.lit(0))).groupBy(*keys, "node").agg(F.max("_asked").alias("_asked")))
    if 2 * nodes.filter("_asked = 1").count() < nodes.count():
        return None
    degrees = step.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("_degree"))
    back = cut(step.join(degrees.filter(F.col("_degree") < limit), keys + ["node"]))
    nothing = F.array().cast(f"array<{nodes.schema['node'].dataType.simpleString()}>")
    fresh = cut(nodes.join(degrees, keys + ["node"], "left_anti").select(*keys, "node", nothing.alias("below"), F.lit(0).alias("reach")))
    found, waiting = [], None
    while not fresh.isEmpty():
        found.append(fresh.select(*keys, F.col("node").alias("source"), "reach"))
        if len(found) > _UPWARDS:
            break
        given = back.join(fresh.withColumnRenamed("node", "next"), keys + ["next"]).select(
            *keys, "node", "_degree", F.lit(1).cast("bigint").alias("_given"), F.array_append("below", F.col("next")).alias("below")
        )
        together = (given if waiting is None else given.unionByName(waiting)).groupBy(*keys, "node", "_degree").agg(
            F.sum("_given").alias("_given"), F.array_distinct(F.flatten(F.collect_list("below"))).alias("below")
        )
        together = cut(together.withColumn("reach", F.size("below")).filter(F.col("reach") < limit - 1))
        fresh = together.filter("_given = _degree").select(*keys, "node", "below", "reach")
        waiting = together.filter("_given < _degree").drop("reach")
    return _union(found) if found else None


def reach(edges: DataFrame, sources: DataFrame, keys: list[str], limit: int | None = 400) -> DataFrame:
    """How many distinct nodes each source reaches, not counting itself (G1).

    With ``limit``, what is far below it is counted by sets of nodes; the search is made for the other sources.
    """
    small = _small_sets(edges, sources, keys, limit) if limit is not None else None
    if small is not None:
        small = cut(small.join(sources.select(*keys, "source").distinct(), keys + ["source"], "left_semi"))
        sources = sources.join(small, keys + ["source"], "left_anti")
    seen = expand(edges, sources, keys, limit=limit)
    size = F.count(F.lit(1))
    capped = (size >= limit) if limit is not None else F.lit(False)
    searched = seen.groupBy(*keys, "source").agg((size - 1).alias("reach"), capped.alias("capped"))
    if small is None:
        return searched
    return searched.unionByName(small.select(*keys, "source", F.col("reach").cast("bigint").alias("reach"), F.lit(False).alias("capped")))


def blast(
    edges: DataFrame,
    sources: DataFrame,
    places: DataFrame,
    keys: list[str],
    hops: int = 2,
    direction: str = "up",
    include_self_file: bool = True,
) -> DataFrame:
    """Nodes within ``hops`` of each source and the distinct files they lie in.

    ``up`` follows callers (what a change here is felt by), ``down`` follows
    callees. ``places`` is ``(keys, node, path)``.
    """
    graph = edges if direction == "down" else reversed_edges(edges, keys)
    seen = expand(graph, sources, keys, max_hops=max(hops, 1))
    located = seen.join(places, keys + ["node"], "left")
    counted = located if include_self_file else located.withColumn(
        "path", F.when(F.col("hop") > 0, F.col("path"))
    )
    per_file = counted.groupBy(*keys, "source", "path").agg(
        F.count(F.when(F.col("hop") > 0, 1)).alias("_nodes")
    )
    return per_file.groupBy(*keys, "source").agg(
        F.sum("_nodes").cast("bigint").alias("symbols"), F.count("path").alias("files")
    )


def closure(edges: DataFrame, sources: DataFrame, keys: list[str], direction: str = "down") -> DataFrame:
    """Everything reachable from each source in one direction, without the source."""
    graph = edges if direction == "down" else reversed_edges(edges, keys)
    return expand(graph, sources, keys).filter("hop > 0").drop("hop")


def highlighted(edges: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Upstream, downstream and the source itself, as one set."""
    itself = sources.select(*keys, "source", F.col("source").alias("node"))
    return (
        closure(edges, sources, keys, "up")
        .unionByName(closure(edges, sources, keys, "down"))
        .unionByName(itself)
        .distinct()
    )


def chains(nodes: DataFrame, edges: DataFrame, keys: list[str], max_depth: int | None = 8) -> DataFrame:
    """Shortest caller path to every node from a node nothing calls.

    ``(keys, id, path, rooted)`` with the path from root to node. One forward
    search from all roots serves every node: the parent is the smallest caller
    one step nearer a root. A node without a root in range gets itself; ``None`` is any range.
    """
    called = edges.select(*keys, F.col("dst").alias("id")).distinct()
    start = cut(
        nodes.select(*keys, "id").join(called, keys + ["id"], "left_anti").withColumn("path", F.array("id"))
    )
    step = cut(edges.select(*keys, F.col("src").alias("id"), F.col("dst").alias("next")))
    found = [start]
    while max_depth is None or len(found) <= max_depth:
        visited = _union([part.select(*keys, "id") for part in found])
        nearer = (
            found[-1]
            .join(step, keys + ["id"])
            .groupBy(*keys, "next")
            .agg(F.min(F.struct("id", "path")).alias("parent"))
            .select(*keys, F.col("next").alias("id"), F.col("parent.path").alias("path"))
            .join(visited, keys + ["id"], "left_anti")
            .withColumn("path", F.concat("path", F.array("id")))
        )
        nearer = cut(nearer)
        if nearer.isEmpty():
            break
        found.append(nearer)
    rooted = _union(found).withColumn("rooted", F.lit(True))
    alone = (
        nodes.select(*keys, "id")
        .join(rooted.select(*keys, "id"), keys + ["id"], "left_anti")
        .withColumn("path", F.array("id"))
        .withColumn("rooted", F.lit(False))
    )
    return rooted.unionByName(alone)


def depth(nodes: DataFrame, edges: DataFrame, keys: list[str], max_depth: int = 5) -> DataFrame:
    """Length of the longest path into each node, at most ``max_depth``.

    A node has depth k when a walk of k edges ends in it. Round k keeps the ends
    of edges that start in round k-1's nodes; cycles stay in every round.
    """
    level = cut(edges.select(*keys, F.col("dst").alias("id")).distinct())
    step = cut(edges.select(*keys, F.col("src").alias("id"), F.col("dst").alias("next")))
    levels = [level]
    for _ in range(max_depth - 1):
        level = cut(
            step.join(level, keys + ["id"], "left_semi").select(*keys, F.col("next").alias("id")).distinct()
        )
        if level.isEmpty():
            break
        levels.append(level)
    counted = _union(levels).groupBy(*keys, "id").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    return nodes.join(counted, keys + ["id"], "left").fillna(0, ["depth"])


def backward_edges(edges: DataFrame, depths: DataFrame, keys: list[str]) -> DataFrame:
    """Edges that do not lead to a deeper column, and all edges, per graph."""
    src = depths.select(*keys, F.col("id").alias("src"), F.col("depth").alias("src_depth"))
    dst = depths.select(*keys, F.col("id").alias("dst"), F.col("depth").alias("dst_depth"))
    return (
        edges.join(src, keys + ["src"])
        .join(dst, keys + ["dst"])
        .groupBy(*keys)
        .agg(
            F.count_if(F.col("dst_depth") <= F.col("src_depth")).alias("backward"),
            F.count(F.lit(1)).alias("edges"),
        )
    )
