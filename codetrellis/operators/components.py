"""Dependency cycles: strongly connected components with several nodes.

Where colours settle in a few rounds, components are told by them. Else the graph is made smaller
without losing a component: what nothing enters or leaves is dropped, pairs that lead to each
other become one node, and a run of nodes with one way in and one way out becomes one
edge. Runs are followed by pointer doubling, so long chains cost rounds by the logarithm of their
length. Every table written in a round holds only what moved in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.session import cut

# rounds of a colouring after which its tables are written together
_TOGETHER = 8
# rounds in which the colours of a graph of short ways settle
_FEW = 4
# a contraction that leaves more than this share of the edges is followed by a colouring
_WORTHWHILE = 0.75


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def follow(pointers: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Where chains of ``pointers(keys, node, to)``, a written table, end, by doubling.

    Two tables: ``(keys, node, end, steps)`` for nodes that come to a node without a pointer, and
    ``(keys, node, ring)`` for those that lead back to themselves, named by the largest node of
    the ring. A node has one pointer at most. Rounds grow with the logarithm of the longest
    chain; each writes the nodes that are still under way.
    """
    open_ = pointers.select(*keys, "node", "to", F.greatest("node", "to").alias("high"), F.lit(1).cast("bigint").alias("steps"))
    total, span, ended = open_.count(), 1, []
    while total and span <= 2 * total:
        ahead = _union([open_, *ended]).select(
            *keys, F.col("node").alias("to"), F.col("to").alias("_to"), F.col("high").alias("_high"), F.col("steps").alias("_steps")
        )
        moved = cut(open_.join(ahead, keys + ["to"], "left"))
        ended.append(moved.filter("_to IS NULL").select(*open_.columns))
        open_ = moved.filter("_to IS NOT NULL").select(
            *keys, "node", F.col("_to").alias("to"), F.greatest("high", "_high").alias("high"), (F.col("steps") + F.col("_steps")).alias("steps")
        )
        span *= 2
        if open_.isEmpty():
            break
    done = _union(ended) if ended else open_
    return (
        done.select(*keys, "node", F.col("to").alias("end"), "steps"),
        open_.select(*keys, "node", F.col("high").alias("ring")),
    )


def _trim(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Drop edges whose start nothing enters or whose end nothing leaves."""
    entered = edges.select(*keys, F.col("dst").alias("src")).distinct()
    left = edges.select(*keys, F.col("src").alias("dst")).distinct()
    return edges.join(entered, keys + ["src"], "left_semi").join(left, keys + ["dst"], "left_semi")


def _renamed(edges: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between the nodes that ``names(keys, node, into)`` puts in their place."""
    src = names.select(*keys, F.col("node").alias("src"), F.col("into").alias("_s"))
    dst = names.select(*keys, F.col("node").alias("dst"), F.col("into").alias("_d"))
    found = edges.join(src, keys + ["src"], "left").join(dst, keys + ["dst"], "left")
    return found.select(*keys, F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst")).filter("src <> dst").distinct()


def _mutual(edges: DataFrame, keys: list[str]) -> DataFrame | None:
    """``(keys, node, into)`` for nodes that lead to a larger one and back, or None."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = edges.filter("src < dst").join(back, keys + ["src", "dst"], "left_semi")
    up = cut(pairs.groupBy(*keys, F.col("src").alias("node")).agg(F.max("dst").alias("to")))
    if up.isEmpty():
        return None
    return cut(follow(up, keys)[0].select(*keys, "node", F.col("end").alias("into")))


def _runs(edges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """Nodes with one way in and one way out, or None if there are none.

    ``(keys, node, into)`` for those that lead back to where they came from, and ``(keys, node, before,
    after)`` for the others, with the nodes in which their run begins and ends.
    """
    one_in = edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("src").alias("before")).filter("_n = 1")
    one_out = edges.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.min("dst").alias("after")).filter("_n = 1")
    inner = cut(one_in.drop("_n").join(one_out.drop("_n"), keys + ["node"]))
    if inner.isEmpty():
        return None
    ends, rings = follow(inner.select(*keys, "node", F.col("after").alias("to")), keys)
    begins, _ = follow(inner.select(*keys, "node", F.col("before").alias("to")), keys)
    run = begins.select(*keys, "node", F.col("end").alias("before")).join(ends.select(*keys, "node", F.col("end").alias("after")), keys + ["node"])
    run = cut(run)
    same = run.filter("before = after").select(*keys, "node", F.col("before").alias("into"))
    round_ = rings.filter("node <> ring").select(*keys, "node", F.col("ring").alias("into"))
    return cut(same.unionByName(round_)), run.filter("before <> after")


def _coloured(edges: DataFrame, keys: list[str], rounds: int | None = None) -> DataFrame | None:
    """Colour each node with the largest node that reaches it (itself included).

    None if colours still move after ``rounds`` rounds.
    """
    parts = [cut(edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))]
    changed = parts[0]
    while True:
        offers = (
            changed.withColumnRenamed("node", "src")
            .join(edges, keys + ["src"])
            .groupBy(*keys, F.col("dst").alias("node"))
            .agg(F.max("colour").alias("offer"))
        )
        # colours only grow, so the largest of all that was written holds
        now = _union(parts).groupBy(*keys, "node").agg(F.max("colour").alias("colour"))
        # only nodes that just changed can change others
        changed = cut(offers.join(now, keys + ["node"]).filter("offer > colour").select(*keys, "node", F.col("offer").alias("colour")))
        if changed.isEmpty():
            return cut(now)
        if rounds is not None:
            rounds -= 1
            if not rounds:
                return None
        parts.append(changed)
        if len(parts) > _TOGETHER:
            parts = [cut(_union(parts).groupBy(*keys, "node").agg(F.max("colour").alias("colour")))]


def _colour_round(live: DataFrame, colours: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One component of every colour, ``(keys, node, into)``, and the edges among what is left.

    A component lies inside one colour. The nodes of a colour that lead back to
    the colour's own node are one component.
    """
    src = colours.select(*keys, F.col("node").alias("src"), "colour")
    dst = colours.select(*keys, F.col("node").alias("dst"), F.col("colour").alias("dst_colour"))
    inside = cut(live.join(src, keys + ["src"]).join(dst, keys + ["dst"]).filter("colour = dst_colour").drop("dst_colour"))
    # backwards from each colour's own node, within the colour
    frontier = cut(colours.filter("node = colour").select(*keys, "colour", "node"))
    members = [frontier]
    while True:
        frontier = cut(
            frontier.withColumnRenamed("node", "dst")
            .join(inside, keys + ["colour", "dst"])
            .select(*keys, "colour", F.col("src").alias("node"))
            .distinct()
            .join(_union(members), keys + ["colour", "node"], "left_anti")
        )
        if frontier.isEmpty():
            break
        members.append(frontier)
        if len(members) > _TOGETHER:
            members = [cut(_union(members))]
    done = cut(_union(members))
    gone = done.select(*keys, F.col("node").alias("src"))
    rest = inside.join(gone, keys + ["src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), keys + ["dst"], "left_anti")
    return done.filter("node <> colour").select(*keys, "node", F.col("colour").alias("into")), rest.select(*keys, "src", "dst")


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, comp, node)`` for every cycle; ``comp`` is its largest node.

    Self-edges and repeated edges change nothing; an empty table has no cycles. The
    steps of the contraction are undone in reverse: a node that was put into another one shares its
    component, a node of a run shares that of its two ends if they have the same one.
    """
    live, steps = cut(edges.filter("src <> dst").select(*keys, "src", "dst").distinct()), []
    while True:
        live = cut(_trim(live, keys))
        size = live.count()
        if not size:
            break
        colours = _coloured(live, keys, _FEW)
        if colours is None:
            live, more = _contracted(live, keys)
            steps += more
            if live.count() > _WORTHWHILE * size:
                colours = _coloured(live, keys)
        if colours is not None:
            found, live = _colour_round(live, colours, keys)
            steps.append(("into", cut(found)))
            live = cut(live)
    return _undone(edges, steps, keys)


def _contracted(live: DataFrame, keys: list[str]) -> tuple[DataFrame, list[tuple[str, DataFrame]]]:
    """A smaller graph with the same components, and the steps to undo."""
    steps = []
    pairs = _mutual(live, keys)
    if pairs is not None:
        steps.append(("into", pairs))
        live = cut(_renamed(live, pairs, keys))
    runs = _runs(live, keys)
    if runs is not None:
        back, through = runs
        steps += [("into", back), ("run", through)]
        # what stands for a ring, or for a run that leads back, has no other edge
        inner = back.select(*keys, "node").unionByName(through.select(*keys, "node")).distinct()
        others = live.join(inner.withColumnRenamed("node", "src"), keys + ["src"], "left_anti").join(
            inner.withColumnRenamed("node", "dst"), keys + ["dst"], "left_anti"
        )
        short = through.select(*keys, F.col("before").alias("src"), F.col("after").alias("dst"))
        live = cut(others.unionByName(short).filter("src <> dst").distinct())
    return live, steps


def _undone(edges: DataFrame, steps: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Components from the steps of a contraction, last one first."""
    nothing = edges.select(*keys, F.col("src").alias("node"), F.col("src").alias("label")).filter(F.lit(False))
    labels = nothing
    for kind, table in reversed(steps):
        if kind == "into":
            known = labels.select(*keys, F.col("node").alias("into"), "label")
            added = table.join(known, keys + ["into"], "left").withColumn("label", F.coalesce("label", "into"))
            # the node that took others in may not have been in a component before
            own = added.select(*keys, F.col("into").alias("node"), "label")
            fresh = added.select(*keys, "node", "label").unionByName(own).distinct()
            labels = cut(labels.unionByName(fresh).distinct())
        else:
            first = labels.select(*keys, F.col("node").alias("before"), "label")
            last = labels.select(*keys, F.col("node").alias("after"), F.col("label").alias("_label"))
            inside = table.join(first, keys + ["before"]).join(last, keys + ["after"]).filter("label = _label")
            labels = cut(labels.unionByName(inside.select(*keys, "node", "label")))
    several = labels.groupBy(*keys, "label").agg(F.max("node").alias("comp"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return labels.join(several.drop("_n"), keys + ["label"]).select(*keys, "comp", "node")
