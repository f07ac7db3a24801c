"""Session helpers: where lineage is cut and how ranks are given out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REPO_KEYS = ["repo", "snap"]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests, laptops) may fall back to a folder of its own;
    on a cluster an unset folder is an error, since an executor's own disk goes
    away with the executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="codetrellis-")
    context.setCheckpointDir(folder)


# the JVM compiles no method above this many bytes of bytecode
_COMPILED_METHOD_BYTES = "8000"


def allow_wide_expressions(spark: SparkSession) -> None:
    """Let stages with very large expressions run outside whole-stage codegen.

    Their one generated method would be too large for the JVM to compile and run
    interpreted; split into many methods the same expressions are compiled.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(_COMPILED_METHOD_BYTES):
        spark.conf.set(name, _COMPILED_METHOD_BYTES)


# the most that one join sends through the driver
_BROADCAST_BYTES = 4 << 20


def broadcast_as_measured(spark: SparkSession) -> None:
    """Let adaptive execution alone choose what is broadcast, by the sizes that shuffles have written.

    Texts made from a few columns, rows exploded from arrays and written tables of either are many times
    what Spark guesses from the files that it reads. Planned by that guess, tables that grow with the
    input would go through the driver. A threshold of the session for adaptive execution is kept.
    """
    guessed, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(guessed)
    if before == "-1":
        return
    if spark.conf.get(measured, None) is None:
        spark.conf.set(measured, str(_BROADCAST_BYTES) if _bytes(before) > _BROADCAST_BYTES else before)
    spark.conf.set(guessed, "-1")


def _bytes(size: str) -> int:
    """A size as Spark's settings have it, such as ``10MB``."""
    units = {"": 0, "k": 1, "m": 2, "g": 3, "t": 4, "p": 5}
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)i?b?", size.strip().lower()).groups()
    return int(number) << 10 * units[unit]


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from what was written."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` beside the checkpoints and continue from the files; for what rounds and many joins build on.

    A checkpoint keeps the size that Spark guessed for the plan, in which a join's is the product of both
    sides; over the rounds of a walk it becomes a number of millions of digits, and planning takes
    all time and memory of the driver. Files have the size they have, and what reads them reads the
    columns it needs.
    """
    spark = df.sparkSession
    broadcast_as_measured(spark)
    if "void" in df.schema.simpleString():  # a type that files lack
        written = checkpointed(df)._jdf
        return DataFrame(spark._jsparkSession.createDataFrame(written.toJavaRDD(), written.schema()), spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


# rows of a table that a join sends to every task
_BRIEF = 10_000


def brief(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it has few rows, so that the other side of a join is not shuffled."""
    return F.broadcast(df) if df.limit(_BRIEF + 1).count() <= _BRIEF else df


def distributed_rank(df: DataFrame, group: list[str], order: list, out: str) -> DataFrame:
    """0-based dense position of every row inside its group, without one task per group.

    Rows are range-partitioned by (group, order), numbered inside each
    partition, and shifted by the number of rows the group has in earlier
    partitions. Rows of equal ``(group, order)`` follow each other in any order;
    ``order`` holds column names or sort expressions. A group that holds most
    of the data is spread over many partitions like any other.
    """
    keys = group + order
    placed = cut(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # at most one row per (group, partition)
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = pieces.select(
        *group,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        placed.join(starts, group + ["_part"])
        .withColumn(out, F.col("_pos") + F.col("_shift"))
        .drop("_part", "_pos", "_shift")
    )


def consecutive(df: DataFrame, group: list[str], order: list[str], prefix: str = "next_") -> DataFrame:
    """Each row next to the row that follows it in its group; the last one drops out.

    The successor's columns get ``prefix``. Positions are dealt out by range, so
    one group may hold most of the rows.
    """
    ranked = distributed_rank(df, group, order, "_at")
    rest = [c for c in df.columns if c not in group]
    follower = ranked.select(
        *group, (F.col("_at") - 1).alias("_at"), *[F.col(c).alias(prefix + c) for c in rest]
    )
    return ranked.join(follower, group + ["_at"]).drop("_at")


# from this many rows on Spark no longer cuts a ranking before its shuffle
_CUT_BEFORE_SHUFFLE = 1000


def top_k(df: DataFrame, group: list[str], order: list, k: int | None, out: str = "rank") -> DataFrame:
    """First ``k`` rows of every group in a total order, 1-based rank in ``out``; ``None`` ranks all.

    A small ``row_number() <= k`` lets Spark cut every partition to k rows per group
    before the shuffle, so a hot group costs k rows per task; larger and open
    rankings are dealt out by range.
    """
    if k is None or k >= _CUT_BEFORE_SHUFFLE:
        ranked = distributed_rank(df, group, order, "_at").withColumn(out, (F.col("_at") + 1).cast("int")).drop("_at")
        return ranked if k is None else ranked.filter(F.col(out) <= k)
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= k)
