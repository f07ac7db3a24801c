"""The graph of files: collapse, layers, districts, orders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrellis.functions import paths, scores
from codetrellis.operators.graph import with_degrees
from codetrellis.session import REPO_KEYS, cut, distributed_rank, top_k

FILE = REPO_KEYS + ["path"]

# fixed values: what a picture of the file graph shows
PICTURE_NODES = 60
PICTURE_EDGES = 130


@dataclass
class FileGraph:
    modules: DataFrame
    edges: DataFrame


def located_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call edges with the files of both ends (J11); external ends have no file."""
    where = symbols.select(*REPO_KEYS, "sym_id", "path")
    return edges.join(
        where.withColumnsRenamed({"sym_id": "src", "path": "src_path"}), REPO_KEYS + ["src"]
    ).join(where.withColumnsRenamed({"sym_id": "dst", "path": "dst_path"}), REPO_KEYS + ["dst"])


def file_pairs(located: DataFrame) -> DataFrame:
    """Call edges and call sites between every two files, one row for each pair."""
    return located.groupBy(*REPO_KEYS, "src_path", "dst_path").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("n").cast("bigint").alias("weight")
    )


def connectedness(pairs: DataFrame) -> DataFrame:
    """Call edges that touch each file; one inside a file counts once (A5)."""
    ends = F.array_distinct(F.filter(F.array("src_path", "dst_path"), lambda p: p.isNotNull()))
    return (
        pairs.select(*REPO_KEYS, "edges", F.explode(ends).alias("path"))
        .groupBy(*FILE)
        .agg(F.sum("edges").alias("weight"))
    )


def file_figures(symbols: DataFrame) -> DataFrame:
    """Distinct symbol names and largest end line per file."""
    return symbols.groupBy(*FILE).agg(
        F.count_distinct("name").alias("symbol_count"), F.max("end_line").alias("lines")
    )


def first_names(symbols: DataFrame, limit: int = 6) -> DataFrame:
    """Names of the first declarations of each file, in order."""
    first = top_k(symbols.select(*FILE, "sym_id", "name"), FILE, ["sym_id"], limit)
    return first.groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("rank", "name"))).getField("name").alias("names")
    )


def shown_symbols(symbols: DataFrame, limit: int = 12) -> DataFrame:
    """Best-connected symbols of each file, one per name, with their place."""
    order: list[Column] = [
        (2 * F.col("fan_in") + F.col("fan_out")).desc(),
        (F.col("kind") == "type"),
        F.col("span").desc(),
        F.col("sym_id"),
    ]
    columns = [*FILE, "name", "sym_id", "kind", "span", "fan_in", "fan_out", "language"]
    per_name = top_k(symbols.select(*columns), FILE + ["name"], order, 1).drop("rank")
    return top_k(per_name, FILE, order, limit, "place")


def classify_files(symbols: DataFrame) -> DataFrame:
    """Layer of each file as the diagram stores it, with the symbols it shows."""
    shown = shown_symbols(symbols)
    entry = F.struct("place", "sym_id", "name", "language")
    listed = shown.groupBy(*FILE).agg(F.array_sort(F.collect_list(entry)).alias("shown"))
    ids = F.col("shown").getField("sym_id")
    return listed.select(
        *FILE,
        scores.classify_layer(F.col("path"), F.col("shown").getField("name")).alias("layer"),
        F.col("shown")[0]["language"].alias("language"),
        F.slice(ids, 1, 8).alias("top_symbols"),
    )


def collapse(
    symbols: DataFrame,
    edges: DataFrame,
    file_refs: DataFrame,
    max_nodes: int | None = None,
    max_edges: int | None = None,
    include_tests: bool = False,
) -> FileGraph:
    """Files as nodes, dependencies as weighted edges.

    An explicit reference weighs 3, a call site 1. The graph is whole unless a limit
    is given; a picture takes ``PICTURE_NODES`` and ``PICTURE_EDGES``.
    """
    inside = symbols.filter("path IS NOT NULL")
    # the edges are many more than the pairs of files, and both tables below need them
    pairs = cut(file_pairs(located_edges(edges, symbols)))
    files = file_figures(inside).join(connectedness(pairs), FILE, "left").fillna(0, ["weight"])
    if not include_tests:
        judged = first_names(inside)
        files = files.join(judged, FILE).filter(
            scores.classify_layer(F.col("path"), F.col("names")) != "test"
        ).drop("names")
    if max_nodes is not None:
        files = top_k(files, REPO_KEYS, [F.col("weight").desc(), F.col("path")], max_nodes).drop("rank")
    modules = files.join(classify_files(inside), FILE).select(
        *FILE,
        paths.basename(F.col("path")).alias("name"),
        paths.dirname(F.col("path")).alias("directory"),
        "layer",
        "language",
        "symbol_count",
        "lines",
        "weight",
        "top_symbols",
    )
    # both tables are read several times below
    modules = cut(modules)
    stated = file_refs.select(*REPO_KEYS, "src_path", "dst_path", F.lit(3).cast("bigint").alias("weight"))
    called = pairs.select(*REPO_KEYS, "src_path", "dst_path", "weight")
    folded = (
        stated.unionByName(called)
        .filter("src_path <> dst_path")
        .groupBy(*REPO_KEYS, "src_path", "dst_path")
        .agg(F.sum("weight").cast("bigint").alias("weight"))
    )
    kept = modules.select(*FILE)
    file_edges = folded.join(
        kept.withColumnRenamed("path", "src_path"), REPO_KEYS + ["src_path"], "left_semi"
    ).join(kept.withColumnRenamed("path", "dst_path"), REPO_KEYS + ["dst_path"], "left_semi")
    if max_edges is not None:
        order = [F.col("weight").desc(), F.col("src_path"), F.col("dst_path")]
        file_edges = top_k(file_edges, REPO_KEYS, order, max_edges).drop("rank")
    file_edges = cut(file_edges.select(*REPO_KEYS, "src_path", "dst_path", "weight"))
    with_fans = with_degrees(
        modules, file_edges.withColumnsRenamed({"src_path": "src", "dst_path": "dst"}), REPO_KEYS, "path"
    )
    return FileGraph(with_fans, file_edges)


def district_rollup(modules: DataFrame) -> DataFrame:
    """Files, symbols, share of symbols and three best-connected names per district."""
    placed = modules.withColumn("district", scores.district(F.col("layer")))
    group = REPO_KEYS + ["district"]
    best = top_k(placed, group, [(F.col("fan_in") + F.col("fan_out")).desc(), F.col("path")], 3)
    names = best.groupBy(*group).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("rank", "name"))).getField("name"), " · "
        ).alias("names")
    )
    sums = placed.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"), F.sum("symbol_count").cast("bigint").alias("symbols")
    )
    # three rows per repository at most
    total = F.sum("symbols").over(Window.partitionBy(*REPO_KEYS))
    return sums.withColumn("share", F.col("symbols") / F.greatest(total, F.lit(1))).join(names, group)


def matrix_order(modules: DataFrame) -> DataFrame:
    """Row of each file in the dependency matrix, 0-based, and its district's first row."""
    keyed = modules.select(
        *FILE,
        scores.district(F.col("layer")).alias("district"),
        scores.district_rank(F.col("layer")).alias("_district"),
        (-F.col("symbol_count")).alias("_size"),
    )
    ranked = distributed_rank(keyed, REPO_KEYS, ["_district", "_size", "path"], "matrix_rank")
    starts = ranked.groupBy(*REPO_KEYS, "district").agg(F.min("matrix_rank").alias("district_start"))
    return ranked.drop("_district", "_size").join(starts, REPO_KEYS + ["district"])


def seed_order(modules: DataFrame, depths: DataFrame) -> DataFrame:
    """First order inside each depth column: district, then size."""
    keyed = modules.join(depths.select(*FILE, "depth"), FILE).select(
        *FILE,
        "depth",
        scores.district_rank(F.col("layer")).alias("_district"),
        (-F.col("symbol_count")).alias("_size"),
    )
    return distributed_rank(keyed, REPO_KEYS + ["depth"], ["_district", "_size", "path"], "seed_rank").drop(
        "_district", "_size"
    )
