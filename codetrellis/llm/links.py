"""Connected components of an edge table, by repeated stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.session import cut


def connected(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(u, v)``; the label is the smallest node reached.

    Large and small stars in turn: every node hangs its larger neighbours, then its
    smaller ones, on the smallest it knows. Minima are combined before the shuffle
    and written, so that the join with them reads two exchanges and adaptive
    execution can split a node with very many neighbours. Rounds grow with the logarithm of the longest path; each
    goes on from files, for the size that Spark guesses for a checkpoint has four times the digits a round later.
    Loops and repeated edges do no harm; an empty table gives an empty table.
    """
    pairs = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        hung = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        hung = cut(hung)
        low = cut(hung.groupBy("u").agg(F.min("v").alias("m")))
        joined = hung.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            joined.select("u", F.col("m").alias("v"))
        )
        pairs = cut(small.filter("u <> v").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
