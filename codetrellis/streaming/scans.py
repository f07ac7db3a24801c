"""A log of scans as a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrellis.operators.drift import compare, successions
from codetrellis.session import REPO_KEYS, cut
from codetrellis.sources.sinks import append_history, read_history

# folders of repositories that a batch of the history is split into
BUCKETS = 64
HISTORY = "repo string, snap string, scanned_at timestamp, sym_key string, span int, branches int, callers bigint"


def deduplicated(files: DataFrame, event_time: str = "scanned_at", delay: str = "1 hour") -> DataFrame:
    """Drop rows that are delivered again within the watermark."""
    return files.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(REPO_KEYS + ["path"])


def windowed_figures(records: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Symbols, lines and branches scanned per repository and tumbling window.

    Scans that arrive after the watermark has passed their window are dropped.
    """
    return (
        records.withWatermark("scanned_at", delay)
        .groupBy(F.window("scanned_at", window), "repo")
        .agg(
            F.count(F.lit(1)).alias("symbols"),
            F.sum("span").cast("bigint").alias("lines"),
            F.sum("branches").cast("bigint").alias("branches"),
        )
        .select(F.col("window.start").alias("window_start"), "repo", "symbols", "lines", "branches")
    )


def _so_far(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What is stored so far; nothing on the first batch."""
    try:
        return spark.read.option("basePath", root).schema(schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stream_drift(
    records: DataFrame, history_root: str, drift_root: str, checkpoint: str, limit: int | None = None
):
    """Compare every arriving scan with the scan before it and store both.

    A scan may arrive in several batches, and late: rows are staged by batch, and each
    batch compares anew the scans it brought rows of and the scans that follow
    them, over all rows staged so far. Replaying a batch rewrites what it wrote. Rows with a
    ``cycle_key``, if the stream has that column, are the cycles of a scan. The
    history is staged in folders by batch and repository bucket; a batch reads the
    buckets it touches. A scan whose entries are gone keeps one row without a kind.
    """
    schema = records.schema
    with_cycles = "cycle_key" in schema.names
    drift_schema = (
        "subject string, kind string, delta bigint, detail string, place int, regression boolean, "
        "improvement boolean, repo string, snap string"
    )

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("repo"), F.lit(BUCKETS)).cast("int")
        staged = batch.withColumn("_batch", F.lit(batch_id)).withColumn("_bucket", bucket)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch", "_bucket").parquet(
            history_root
        )
        stored = _so_far(spark, history_root, f"{schema.toDDL()}, _batch bigint, _bucket int")
        own = stored.filter(F.col("_batch") == batch_id)
        touched = [r[0] for r in own.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
        if not touched:
            return
        arrived = cut(own.select(*REPO_KEYS).distinct())
        known = stored.filter(F.col("_bucket").isin(touched)).join(arrived.select("repo").distinct(), "repo", "left_semi")
        scans = cut(known.groupBy(*REPO_KEYS).agg(F.max("scanned_at").alias("scanned_at")))
        after = arrived.withColumnRenamed("snap", "previous")
        pairs = successions(scans)
        pairs = cut(
            pairs.join(arrived, REPO_KEYS, "left_semi").unionByName(pairs.join(after, ["repo", "previous"], "left_semi")).distinct()
        )
        asked = pairs.select(*REPO_KEYS).unionByName(pairs.select("repo", F.col("previous").alias("snap"))).distinct()
        rows = known.join(asked, REPO_KEYS, "left_semi")
        # numbers one by one are kept by hash, a struct of them is sorted; of equal batches each takes the same row
        newest = [F.max_by(v, "_batch").alias(v) for v in ("span", "branches", "callers")]
        # a comparison reads its tables several times, the history would be read and joined each time
        symbols = cut(rows.filter("sym_key IS NOT NULL").groupBy(*REPO_KEYS, "sym_key").agg(*newest))
        cycles = (
            cut(rows.filter("cycle_key IS NOT NULL").select(*REPO_KEYS, "cycle_key").distinct())
            if with_cycles
            else spark.createDataFrame([], "repo string, snap string, cycle_key string")
        )
        entries = cut(compare(symbols, cycles, pairs, limit))
        # a scan that had entries and has none now
        before = _so_far(spark, drift_root, drift_schema).select(*REPO_KEYS).distinct()
        gone = before.join(pairs, REPO_KEYS, "left_semi").join(entries, REPO_KEYS, "left_anti")
        append_history(entries.unionByName(cut(gone), allowMissingColumns=True), drift_root)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_drift(spark: SparkSession, drift_root: str) -> DataFrame:
    """The entries that ``stream_drift`` stored."""
    return read_history(spark, drift_root).filter("kind IS NOT NULL")
