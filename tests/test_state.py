"""Drift by keyed state against a batch over all scans."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from codetrellis.operators import drift
from codetrellis.sources.sinks import SCANS
from codetrellis.streaming.scans import HISTORY
from codetrellis.streaming.state import MOVES, PROVIDER, moved_entries, stream_moves

ROWS = HISTORY + ", cycle_key string"


@pytest.fixture
def stateful(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.shuffle.partitions": "2"}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        spark.conf.set(name, value)


def scan_rows(repo, n, symbols=24):
    when = dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    kept = [i for i in range(symbols) if (i + n) % 7]
    rows = [(repo, f"s{n}", when, f"f.py#g{i}", 10 + i * (n % 4), i % 3, (i * n) % 5, None) for i in kept]
    return rows + [(repo, f"s{n}", when, None, None, None, None, f"a|b|c{n // 2}|d")]


def run(spark, folder):
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    scans = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/scans")
    query = (
        stream_moves(rows, scans, buckets=3)
        .writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query.recentProgress


def test_work_of_a_batch_does_not_grow(stateful, tmp_path):
    spark, folder, everything = stateful, str(tmp_path), []
    for n in range(20):
        rows = scan_rows("p", n) + (scan_rows("q", n) if n % 3 else [])
        everything += rows
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
        told = sorted({(r[0], r[1], r[2]) for r in rows})
        spark.createDataFrame(told, SCANS).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
    # a last announcement lets the watermark pass the scans before it
    end = dt.datetime(2024, 6, 1)
    spark.createDataFrame([("~", "end", end, None, None, None, None, "x")], ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    spark.createDataFrame([("~", "end", end)], SCANS).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
    progress = run(spark, folder)
    table = spark.createDataFrame(everything, ROWS)
    pairs = drift.successions(table.select("repo", "snap", "scanned_at").distinct())
    cycles = table.filter("cycle_key IS NOT NULL").select("repo", "snap", "cycle_key")
    batch = drift.compare(table.filter("sym_key IS NOT NULL").drop("scanned_at", "cycle_key"), cycles, pairs)
    streamed = moved_entries(spark.read.schema(MOVES).parquet(f"{folder}/out"))
    assert {tuple(r) for r in streamed.select(batch.columns).collect()} == {tuple(r) for r in batch.collect()}
    assert batch.count() > 50
    read = [p["numInputRows"] for p in progress if p["numInputRows"]]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["numInputRows"]]
    assert len(read) >= 20 and max(read) <= 2 * (len(scan_rows("p", 1)) + 1) + 2
    assert max(held[10:]) <= 1.5 * max(held[:10])


def test_pieces_in_any_order_within_the_delay(stateful, tmp_path):
    spark, folder = stateful, str(tmp_path)
    scans = {n: scan_rows("p", n) for n in range(3)}
    pieces = [scans[1][::2], scans[0][1::2], scans[2], scans[0][::2], scans[1][1::2]]
    for part in pieces:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(f"{folder}/rows")
    told = [(r[0][0], r[0][1], r[0][2]) for r in scans.values()]
    spark.createDataFrame(told, SCANS).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
    end = dt.datetime(2024, 6, 1)
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/rows")
    told = spark.readStream.schema(SCANS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/scans")

    def go():
        stream_moves(rows, told, delay="30 days", buckets=2).writeStream.format("parquet").outputMode("append").option(
            "checkpointLocation", f"{folder}/state"
        ).option("path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()

    go()
    spark.createDataFrame([("~", "end", end)], SCANS).coalesce(1).write.mode("append").parquet(f"{folder}/scans")
    go()
    table = spark.createDataFrame([r for rows_ in scans.values() for r in rows_], ROWS)
    pairs = drift.successions(table.select("repo", "snap", "scanned_at").distinct())
    cycles = table.filter("cycle_key IS NOT NULL").select("repo", "snap", "cycle_key")
    batch = drift.compare(table.filter("sym_key IS NOT NULL").drop("scanned_at", "cycle_key"), cycles, pairs)
    streamed = moved_entries(spark.read.schema(MOVES).parquet(f"{folder}/out"))
    assert {tuple(r) for r in streamed.select(batch.columns).collect()} == {tuple(r) for r in batch.collect()}
    assert batch.count() > 5
