"""Texts are lexed once: within a corpus, across snapshots and between runs; comments of any depth."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from codetrellis.operators.declarations import declarations
from codetrellis.operators.facts import FactStore
from codetrellis.operators.lexing import blank_trivia, comment_depth
from codetrellis.plans.analysis import Analysis, Options
from codetrellis.sources.corpus import read_corpus

RAW = "repo string, snap string, path string, content string"
SHARED = "def one(a):\n    return two(a)\n\ndef two(a):\n    if a:\n        return a\n"


def rows_of(spark, rows):
    return read_corpus(spark.createDataFrame(rows, RAW))


def symbols(found):
    return sorted(tuple(r) for r in found.symbols.select("repo", "snap", "path", "name", "line", "end_line", "branches", "sym_id").collect())


def copies():
    rows = [(f"r{i % 5}", f"s{i % 3}", f"src/f{i}.py", SHARED) for i in range(60)]
    rows += [("r0", "s0", f"src/g{i}.py", f"def own_{i}():\n    one({i})\n") for i in range(7)]
    # the same text under another language is another text
    return rows + [("r0", "s0", "a.go", "func f() { g() }"), ("r0", "s0", "a.rs", "func f() { g() }"), ("r1", "s0", "empty.py", "")]


def test_equal_texts_are_lexed_once(spark):
    files, lexed = rows_of(spark, copies()), Observation("lexed")
    found = declarations(files, lexed=lexed)
    assert lexed.get == {"texts": 1 + 7 + 2 + 1}
    alone = symbols(declarations(rows_of(spark, [r for r in copies() if r[2] in ("a.go", "a.rs", "src/g3.py", "src/f7.py")])))
    assert len(alone) == 4 and {r[:-1] for r in alone} <= {r[:-1] for r in symbols(found)}
    assert len(symbols(found)) == 60 * 2 + 7 + 1
    assert found.calls.filter("callee = 'two'").count() == 60


def test_a_store_reads_only_new_texts(spark, tmp_path):
    store = FactStore(spark, str(tmp_path), buckets=4)
    first, second = Observation("first"), Observation("second")
    rows = copies()
    changed = [(r, "later", p, t) for r, _, p, t in rows[:-5]] + [("r9", "later", "src/new.py", "def new():\n    pass\n")]
    a = declarations(rows_of(spark, rows), store, first)
    b = declarations(rows_of(spark, changed), store, second)
    segments = len(store.facts.segments())
    again = declarations(rows_of(spark, rows), store)
    assert (first.get["texts"], second.get["texts"], len(store.facts.segments())) == (11, 1, segments)
    assert symbols(a) == symbols(again) == symbols(declarations(rows_of(spark, rows)))
    assert symbols(b) == symbols(declarations(rows_of(spark, changed)))
    assert store.texts.read().count() == 12


def test_analysis_takes_a_store(spark, tmp_path):
    files = rows_of(spark, copies())
    store = FactStore(spark, str(tmp_path))
    plain, kept = Analysis(files), Analysis(files, Options(store=store))
    assert plain.edges.exceptAll(kept.edges).count() == kept.edges.exceptAll(plain.edges).count() == 0
    assert plain.edges.count() > 0


@pytest.mark.parametrize("depth", [1, 3, 4, 5, 25, 26, 40, 300])
def test_comments_of_any_depth(spark, depth):
    text = "fn a() { /* x " + "/* y " * (depth - 1) + "lost() " + "*/ " * depth + "kept() }\nlet s = \"/*\"; // /*\nfn b() { \"*/\" }"
    found = declarations(rows_of(spark, [("r", "s", "a.rs", text)]))
    assert [r.callee for r in found.calls.collect()] == ["kept"]
    assert sorted(r.name for r in found.symbols.collect()) == ["a", "b"]


def test_depth_is_never_too_small(spark):
    def deepest(text):
        most = now = i = 0
        while i < len(text):
            if text.startswith("/*", i):
                now, i = now + 1, i + 2
            elif now and text.startswith("*/", i):
                now, i = now - 1, i + 2
            else:
                i += 1
            most = max(most, now)
        return most

    texts = ["", "/**/", "/*/ */", "/*/*/ */ */", "*/*/**/", "a */* b */* c", "/* */" * 50, "/*" * 9, "/*/*/*/"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", comment_depth(F.col("t")).alias("d")).collect():
        assert r.d >= deepest(r.t), r.t
    assert df.filter(comment_depth(F.col("t")) > 20).count() == 0


def test_blanking_keeps_length_at_any_depth(spark):
    text = "a /* 1\n" + "/* 2\n" * 70 + "*/" * 71 + " b /* open /* deeper"
    row = spark.createDataFrame([(text, "kotlin")], "t string, l string").select(blank_trivia(F.col("t"), F.col("l")).alias("b")).first()
    assert len(row.b) == len(text) and row.b.count("\n") == text.count("\n")
    assert [c for c in row.b if c.isalpha()] == ["a", "b"]
