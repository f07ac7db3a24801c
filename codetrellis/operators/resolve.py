"""Calls to symbols (J1-J8) and the folded call graph (A1, A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.functions.rulebook import rules
from codetrellis.operators.graph import fold_edges
from codetrellis.session import REPO_KEYS, distributed_rank


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row per (caller, callee name, receiver) with ``n`` call sites and its target.

    Calls at file scope have no caller and are left out. Candidates are folded
    to one row per key before the joins, so a name that is declared or called a
    million times costs one build row, never pairs. The order of preference:
    the receiver's type, a single same-file candidate for guarded names, a
    single candidate, the caller's container, its file, the first anywhere.
    """
    sites = (
        calls.filter("caller_id IS NOT NULL")
        .withColumn("receiver", F.when(~F.col("receiver").isin("self", "this"), F.col("receiver")))
        .groupBy(*REPO_KEYS, "path", "caller_id", "caller_container", "callee", "receiver")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    types = symbols.filter("kind = 'type'").select(
        *REPO_KEYS, F.col("name").alias("receiver"), F.lit(True).alias("receiver_is_type")
    ).distinct()
    callable_ = symbols.filter("kind <> 'type'").withColumnRenamed("name", "callee")
    anywhere = callable_.groupBy(*REPO_KEYS, "callee").agg(
        F.count(F.lit(1)).alias("name_count"), F.min("sym_id").alias("name_first")
    )
    by_container = (
        callable_.filter("container IS NOT NULL")
        .groupBy(*REPO_KEYS, "callee", "container")
        .agg(F.min("sym_id").alias("first"))
    )
    by_file = callable_.groupBy(*REPO_KEYS, "callee", "path").agg(
        F.count(F.lit(1)).alias("file_count"), F.min("sym_id").alias("file_first")
    )
    name_key = REPO_KEYS + ["callee"]
    looked_up = (
        sites.join(anywhere, name_key, "left")
        .join(by_file, name_key + ["path"], "left")
        .join(
            by_container.select(*name_key, F.col("container").alias("caller_container"), F.col("first").alias("own_first")),
            name_key + ["caller_container"],
            "left",
        )
        .join(
            by_container.select(*name_key, F.col("container").alias("receiver"), F.col("first").alias("receiver_first")),
            name_key + ["receiver"],
            "left",
        )
        # sites without a receiver match no type; a key of their own keeps them apart
        .withColumn(
            "_receiver",
            F.coalesce("receiver", F.concat(F.lit("\0"), F.xxhash64("path", "callee").cast("string"))),
        )
        .join(types.withColumnRenamed("receiver", "_receiver"), REPO_KEYS + ["_receiver"], "left")
        .drop("_receiver")
    )
    guarded = F.col("receiver").isNotNull() & F.col("callee").isin(rules.STANDARD_METHODS)
    target = (
        F.when(F.col("receiver_is_type") & F.col("receiver_first").isNotNull(), F.col("receiver_first"))
        .when(guarded, F.when(F.col("file_count") == 1, F.col("file_first")))
        .when(F.col("name_count") == 1, F.col("name_first"))
        .otherwise(F.coalesce("own_first", "file_first", "name_first"))
    )
    return looked_up.select(
        *REPO_KEYS,
        "path",
        "caller_id",
        "callee",
        "receiver",
        "n",
        target.alias("target_id"),
        F.col("name_count").isNull().alias("unknown_name"),
    )


def external_symbols(resolved: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """One symbol per name nobody declares (J8), numbered after the known ones.

    Ids continue past the largest known id of the repository in name order.
    """
    names = (
        resolved.filter("unknown_name AND callee <> ''")
        .select(*REPO_KEYS, F.col("callee").alias("name"))
        .distinct()
    )
    ranked = distributed_rank(names, REPO_KEYS, ["name"], "_rank")
    top = symbols.groupBy(*REPO_KEYS).agg((F.max("sym_id") + 1).alias("_from"))
    first_use = calls.filter("caller_id IS NOT NULL").groupBy(*REPO_KEYS, F.col("callee").alias("name")).agg(
        F.min_by("language", F.struct("path", "line", "language")).alias("language")
    )
    return (
        ranked.join(top, REPO_KEYS)
        .join(first_use, REPO_KEYS + ["name"])
        .select(
            *REPO_KEYS,
            (F.col("_from") + F.col("_rank")).alias("sym_id"),
            "name",
            "language",
            F.lit("function").alias("kind"),
            F.lit(0).alias("line"),
            F.lit(0).alias("end_line"),
            F.lit(0).alias("branches"),
            F.lit(0).alias("max_nesting"),
            F.lit(True).alias("is_external"),
        )
    )


def call_edges(resolved: DataFrame, externals: DataFrame | None = None) -> DataFrame:
    """``edges(repo, snap, src, dst, n)``: folded calls without self-edges (A1)."""
    known = resolved.filter("target_id IS NOT NULL").select(
        *REPO_KEYS, F.col("caller_id").alias("src"), F.col("target_id").alias("dst"), "n"
    )
    if externals is not None:
        outside = (
            resolved.filter("unknown_name AND callee <> ''")
            .withColumnRenamed("callee", "name")
            .join(externals.select(*REPO_KEYS, "name", F.col("sym_id").alias("dst")), REPO_KEYS + ["name"])
            .select(*REPO_KEYS, F.col("caller_id").alias("src"), "dst", "n")
        )
        known = known.unionByName(outside)
    return fold_edges(known, REPO_KEYS)
