"""Log tables, histories and forests of repositories."""

import datetime as dt
import os

from pyspark.sql import functions as F

from codetrellis.sources import forest, storage
from codetrellis.sources.forest import read_forest
from codetrellis.sources.logstore import LogTable
from codetrellis.sources.sinks import CYCLES, RECORDS, SCANS, History, latest_scans

SCHEMA = "k string, n int, v array<struct<a:int,b:string>>"


def test_appends_merge_by_levels(spark, tmp_path):
    log = LogTable(spark, str(tmp_path), SCHEMA, ("k",), ("k", "n"), buckets=2, fan=3)
    assert log.read().count() == 0
    expected = {}
    for i in range(11):
        rows = [(f"k{i % 4}", i % 3, [(i, "x")]), ("same", 0, [(i, None)])]
        log.append(spark.createDataFrame(rows, SCHEMA))
        expected |= {(k, n): v for k, n, v in rows}
        assert len(log.segments()) <= 2 * 3
        assert {(r.k, r.n): [tuple(x) for x in r.v] for r in log.read().collect()} == expected
    # files of segments that no list names are gone
    named = {r["segment"] for r in log.segments()}
    assert len(storage.children(spark, f"{tmp_path}/segments")) <= len(named) + 3
    assert len(storage.children(spark, f"{tmp_path}/lists")) <= 2
    only = spark.createDataFrame([("same",)], "k string")
    assert [(r.k, r.v[0].a) for r in log.read(only).collect()] == [("same", 10)]
    log.replace(log.read().filter("k = 'same'"))
    assert log.read().count() == 1 and len(log.segments()) == 1


def test_a_failed_append_is_not_seen(spark, tmp_path):
    log = LogTable(spark, str(tmp_path), "k string, n int", ("k",))
    log.append(spark.createDataFrame([("a", 1)], "k string, n int"))
    before = log.segments()
    os.makedirs(f"{tmp_path}/lists/000000000009")  # a list without the mark of its end
    os.makedirs(f"{tmp_path}/segments/_segment=half")
    assert log.segments() == before and log.read().count() == 1
    log.append(spark.createDataFrame([("b", 2)], "k string, n int"))
    assert log.read().count() == 2


def test_ten_thousand_scans_stay_few_files(spark, tmp_path):
    history = History(spark, str(tmp_path), buckets=4, fan=3)
    start = dt.datetime(2024, 1, 1)
    for part in range(10):
        ids = spark.range(part * 1000, part * 1000 + 1000)
        repo = F.concat(F.lit("r"), (F.col("id") % 50).cast("string"))
        scans = ids.select(repo.alias("repo"), F.col("id").cast("string").alias("snap"), (F.lit(start) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("scanned_at"))
        records = scans.select("repo", "snap", F.lit("f#a").alias("sym_key"), F.lit(1).alias("span"), F.lit(1).alias("branches"), F.lit(1).cast("bigint").alias("callers"))
        history.append(scans, records)
    assert history.scans.read().count() == history.records.read().count() == 10_000
    assert history.records.files() <= 4 * 2 * 3
    newest = {(r.repo, r.snap) for r in history.latest.read().collect()}
    assert newest == {(r.repo, r.snap) for r in latest_scans(history.scans.read()).collect()} and len(newest) == 50
    assert history.latest.files() == 1


def test_history_replaces_a_scan_written_again(spark, tmp_path):
    history = History(spark, str(tmp_path))
    when = dt.datetime(2024, 1, 1)
    for span in (5, 7):
        history.append(
            spark.createDataFrame([("r", "1", when)], SCANS),
            spark.createDataFrame([("r", "1", "f#a", span, 1, 1)], RECORDS),
            spark.createDataFrame([("r", "1", "a|b")], CYCLES),
        )
    assert [r.span for r in history.records.read().collect()] == [7]
    assert history.scans.read().count() == history.cycles.read().count() == history.latest.read().count() == 1


def tree(root, files):
    for path, data in files.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as out:
            out.write(data)


FILES = {
    "one/src/a.py": b"x\r\ny\r", "one/src/deep/er/b.go": "é".encode(), "one/top.rs": b"\xe9",
    "one/node_modules/c.js": b"x", "one/src/build/d.js": b"x", "one/.git/e.py": b"x", "one/src/.f.py": b"x",
    "two/g.txt": b"x", "two/src/big.py": b"x" * 100, "three/lib/h.swift": b"func f() {}", ".hidden/i.py": b"x", "vendor/j.py": b"x",
}


def test_forest_of_repositories(spark, tmp_path):
    tree(tmp_path, FILES)
    found = read_forest(spark, str(tmp_path), max_bytes=50, snap="now")
    assert {(r.repo, r.snap, r.path, r.content, r.lines) for r in found.collect()} == {
        ("one", "now", "src/a.py", "x\ny\n", 3), ("one", "now", "src/deep/er/b.go", "é", 1), ("one", "now", "top.rs", "é", 1),
        ("three", "now", "lib/h.swift", "func f() {}", 1),
    }
    assert read_forest(spark, f"file://{tmp_path}", max_bytes=None).count() == 5


def test_snapshots_are_folders_when_asked(spark, tmp_path):
    tree(tmp_path, {"r/s1/a.py": b"1", "r/s2/a.py": b"2", "r/s2/src/b.py": b"3", "q/s1/c.py": b"4"})
    found = read_forest(spark, str(tmp_path), snaps=True)
    assert {(r.repo, r.snap, r.path) for r in found.collect()} == {("r", "s1", "a.py"), ("r", "s2", "a.py"), ("r", "s2", "src/b.py"), ("q", "s1", "c.py")}


def test_pruned_folders_are_never_opened(tmp_path, monkeypatch):
    tree(tmp_path, FILES)
    opened = []
    scan = os.scandir
    monkeypatch.setattr(forest.os, "scandir", lambda p: opened.append(str(p)) or scan(p))
    reader = forest.ForestReader({"path": str(tmp_path), "tasks": "3"})
    parts = reader.partitions()
    rows = sum(b.num_rows for part in parts for b in reader.read(part))
    assert len(parts) == 3 and rows == 5
    assert not [p for p in opened if any(x in p for x in ("node_modules", "build", ".git", ".hidden", "vendor"))]


def test_a_large_repository_is_read_by_many_tasks(tmp_path):
    tree(tmp_path, {f"big/m{i}/s{j}/f.py": b"x" for i in range(5) for j in range(6)})
    parts = forest.ForestReader({"path": str(tmp_path), "tasks": "10"}).partitions()
    assert len(parts) == 10 and sum(len(p.units) for p in parts) == 36


def test_empty_folder(spark, tmp_path):
    assert read_forest(spark, str(tmp_path)).count() == 0
