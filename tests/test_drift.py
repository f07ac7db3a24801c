"""Drift replay, thresholds, sinks and the drift stream."""

import datetime as dt

from pyspark.sql import functions as F

from codetrellis.operators import drift, explain
from codetrellis.operators.quality import digest
from codetrellis.sources.sinks import append_history, read_history, write_report
from codetrellis.streaming.scans import HISTORY, read_drift, stream_drift

RECORD = "repo string, snap string, sym_key string, span int, branches int, callers bigint"


def compared(spark, before, now, cycles=(), limit=8):
    rows = [("r", "a", *x) for x in before] + [("r", "b", *x) for x in now]
    history = spark.createDataFrame(rows, RECORD)
    pairs = spark.createDataFrame([("r", "a", "b")], "repo string, previous string, snap string")
    found = spark.createDataFrame(list(cycles), "repo string, snap string, cycle_key string")
    got = drift.compare(history, found, pairs, limit).orderBy("place").collect()
    return [(r.kind, r.subject, r.delta, r.detail) for r in got]


def test_thresholds(spark):
    before = [("f#a", 20, 3, 5), ("f#b", 20, 3, 5), ("f#c", 30, 3, 5), ("f#d", 30, 1, 5), ("f#e", 9, 1, 1), ("f#g", 9, 1, 1)]
    now = [("f#a", 31, 3, 6), ("f#b", 32, 5, 7), ("f#c", 18, 3, 3), ("f#d", 19, 1, 4), ("f#n", 1, 1, 1), ("f#m", 1, 1, 1), ("f#o", 1, 1, 1)]
    assert compared(spark, before, now) == [
        ("grew", "b", 12, "2"), ("shrank", "c", -12, ""), ("appeared", "", 3, ""), ("gainedCallers", "b", 2, ""), ("lostCallers", "c", -2, ""),
    ]


def test_new_cycles_come_first(spark):
    cycles = [("r", "a", "a.py|b.py"), ("r", "b", "a.py|b.py"), ("r", "b", "c.py|d.py|e.py|f.py")]
    got = compared(spark, [("f#a", 1, 0, 0)], [("f#a", 99, 0, 0)], cycles)
    assert got == [("newCycle", "c.py → d.py → e.py", 1, ""), ("grew", "a", 98, "")]


def test_replay_is_stable(spark):
    now = [(f"f#{i}", 5 + i, i % 4, i % 7) for i in range(60)]
    before = [(k, max(1, s - 30), b, max(0, c - 3)) for k, s, b, c in now]
    first = compared(spark, before, now)
    assert len(first) == 8
    assert all(compared(spark, before, now) == first for _ in range(3))


def test_first_scan_has_no_entries(spark):
    scans = spark.createDataFrame([("r", "a", dt.datetime(2024, 1, 1))], "repo string, snap string, scanned_at timestamp")
    pairs = drift.successions(scans)
    history = spark.createDataFrame([("r", "a", f"f#{i}", 1, 1, 1) for i in range(9)], RECORD)
    cycles = spark.createDataFrame([("r", "a", "x|y")], "repo string, snap string, cycle_key string")
    assert drift.compare(history, cycles, pairs).count() == 0


def test_last_symbol_of_a_key_counts(spark):
    symbols = spark.createDataFrame(
        [("r", "a", 1, "f.py", "go", "function", False, 5, 1, 2), ("r", "a", 2, "f.py", "go", "function", False, 9, 3, 0),
         ("r", "a", 3, "f.py", "T", "type", False, 9, 3, 0), ("r", "a", 4, None, "x", "function", True, 1, 0, 9)],
        "repo string, snap string, sym_id bigint, path string, display string, kind string, is_external boolean, span int, branches int, fan_in bigint",
    )
    assert [tuple(r) for r in drift.scan_record(symbols).collect()] == [("r", "a", "f.py#go", 9, 3, 0)]


def test_history_replaces_a_scan(spark, tmp_path):
    root = str(tmp_path / "history")

    def scan(snap, span):
        return spark.createDataFrame([("r", snap, "f#a", span, 1, 1)], RECORD)

    for snap, span in (("1", 5), ("2", 6), ("1", 7)):
        append_history(scan(snap, span), root)
    assert {(r.snap, r.span) for r in read_history(spark, root).collect()} == {("1", 7), ("2", 6)}


def test_keys_are_text(spark, tmp_path):
    root = str(tmp_path / "keys")
    append_history(spark.createDataFrame([("01", "007", "f#a", 1, 1, 1), ("1", "12e5", "f#a", 1, 1, 1)], RECORD), root)
    assert {(r.repo, r.snap) for r in read_history(spark, root).collect()} == {("01", "007"), ("1", "12e5")}


def test_split_and_late_scans_and_cycles(spark, tmp_path):
    """Rows of scans in any order and in pieces end in what a batch over all rows gives."""
    schema = HISTORY + ", cycle_key string"
    rows = []
    for n in range(4):
        when = dt.datetime(2024, 1, 1 + n)
        rows += [("01", f"00{n}", when, f"f#{i}", 10 + 13 * n * (i % 2), i, 1, None) for i in range(10)]
        rows += [("01", f"00{n}", when, None, None, None, None, f"a|b|c{n // 2}")]
    halves = {(n, k): [r for r in rows if r[1] == f"00{n}"][k::2] for n in range(4) for k in range(2)}
    source = str(tmp_path / "in")
    for part in [(0, 0), (3, 0), (2, 1), (0, 1), (3, 1), (1, 0), (2, 0), (1, 1)]:
        spark.createDataFrame(halves[part], schema).coalesce(1).write.mode("append").parquet(source)
        stream_drift(
            spark.readStream.schema(schema).parquet(source),
            str(tmp_path / "history"), str(tmp_path / "drift"), str(tmp_path / "state"),
        ).trigger(availableNow=True).start().awaitTermination()
    everything = spark.createDataFrame(rows, schema)
    pairs = drift.successions(everything.select("repo", "snap", "scanned_at").distinct())
    cycles = everything.filter("cycle_key IS NOT NULL").select("repo", "snap", "cycle_key")
    batch = drift.compare(everything.filter("sym_key IS NOT NULL").drop("scanned_at", "cycle_key"), cycles, pairs)
    streamed = read_drift(spark, str(tmp_path / "drift"))
    assert {tuple(r) for r in streamed.select(batch.columns).collect()} == {tuple(r) for r in batch.collect()}
    assert batch.filter("kind = 'newCycle'").count() == 1 and batch.count() == streamed.count() == 16


def test_a_batch_compares_scans_that_were_written_once(spark, tmp_path, monkeypatch):
    from codetrellis.streaming import scans

    plans, compare = [], scans.compare

    def watched(history, cycles, *rest):
        plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in (history, cycles))
        return compare(history, cycles, *rest)

    monkeypatch.setattr(scans, "compare", watched)
    schema = HISTORY + ", cycle_key string"
    rows = [("r", s, dt.datetime(2024, 1, d), "f#1", 10 * d, d, 1, None) for s, d in (("a", 1), ("b", 3))]
    rows += [("r", "b", dt.datetime(2024, 1, 3), None, None, None, None, "x|y")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream_drift(
        spark.readStream.schema(schema).parquet(source), *[str(tmp_path / n) for n in ("history", "drift", "state")]
    ).trigger(availableNow=True).start().awaitTermination()
    assert len(plans) == 2 and not any("Join" in plan or "Aggregate" in plan for plan in plans)
    got = read_drift(spark, str(tmp_path / "drift")).select("kind", "subject", "delta", "detail").collect()
    assert {tuple(r) for r in got} == {("newCycle", "x → y", 1, ""), ("grew", "1", 20, "2")}


def test_report_keeps_other_snapshots(spark, tmp_path):
    root = str(tmp_path / "report")
    for snap in ("a", "b"):
        write_report({"t": spark.createDataFrame([("r", snap, 1)], "repo string, snap string, x int")}, root)
    assert spark.read.parquet(f"{root}/t").count() == 2


def test_stream_equals_batch(spark, tmp_path):
    """Scans arriving one file at a time give what a batch over all scans gives."""
    rows = []
    for repo in ("p", "q"):
        for n in range(4):
            when = dt.datetime(2024, 1, 1 + n)
            rows += [(repo, f"s{n}", when, f"f#{i}", 10 + i * n, i, (i * n) % 5) for i in range(n, 12 + n)]
    everything = spark.createDataFrame(rows, HISTORY)
    source = str(tmp_path / "in")
    for n in range(4):
        everything.filter(F.col("snap") == f"s{n}").coalesce(1).write.mode("append").parquet(source)
        query = stream_drift(
            spark.readStream.schema(HISTORY).parquet(source),
            str(tmp_path / "history"), str(tmp_path / "drift"), str(tmp_path / "state"),
        ).trigger(availableNow=True).start()
        query.awaitTermination()
    streamed = read_history(spark, str(tmp_path / "drift"))
    pairs = drift.successions(everything.select("repo", "snap", "scanned_at").distinct())
    none = spark.createDataFrame([], "repo string, snap string, cycle_key string")
    batch = drift.compare(everything.drop("scanned_at"), none, pairs)
    assert digest(streamed).first() == digest(batch.select(*streamed.columns)).first()
    assert batch.count() > 4
    assert read_history(spark, str(tmp_path / "history")).count() == everything.count()


def test_labels_keep_unknown_values(spark):
    df = spark.createDataFrame([("ui",), ("odd",)], "layer string")
    got = explain.with_label(df, explain.labels(spark), "layer", "layer", "text").collect()
    assert {r.layer: r.text for r in got} == {"ui": "user interface", "odd": "odd"}


def test_report_tables_are_built_on_demand(spark, corpus_of, tmp_path):
    from codetrellis.plans.analysis import Analysis, Options
    from codetrellis.sources.sinks import write_json_documents

    files = corpus_of({
        "pkg/a.py": "from pkg.b import two\n\ndef one():\n    two()\n",
        "pkg/b.py": "from pkg.a import one\n\ndef two():\n    one()\n\ndef three():\n    two()\n",
    })
    report = Analysis(files, Options(include_external=True)).tables()
    assert "content" not in report["files"].columns and {"hubs", "chains", "cycles", "route", "explanations"} < set(report)
    write_report(report, str(tmp_path))
    for name in report:
        assert spark.read.parquet(f"{tmp_path}/{name}").columns
    assert spark.read.parquet(f"{tmp_path}/cycles").count() == 2
    write_json_documents(report["summary"], str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_drift_names_the_scan_before(spark, corpus_of):
    from codetrellis.plans.analysis import Analysis

    history = spark.createDataFrame([("r", "0", f"a.py#f{i}", 1, 1, 1) for i in range(4)], RECORD)
    none = spark.createDataFrame([], "repo string, snap string, cycle_key string")
    a = Analysis(corpus_of({"a.py": "def one():\n    pass\n"}))
    now = history.unionByName(a.scan_record().select(history.columns))
    scans = spark.createDataFrame([("r", "0", dt.datetime(2024, 1, 1)), ("r", "a", dt.datetime(2024, 1, 2))], "repo string, snap string, scanned_at timestamp")
    found = a.drift(now, none, scans).collect()
    assert [(r.kind, r.delta, r.previous, r.previous_at) for r in found] == [("vanished", -4, "0", dt.datetime(2024, 1, 1))]
