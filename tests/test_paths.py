from pyspark.sql import functions as F

from codetrellis.functions import paths, scores
from codetrellis.sources.corpus import read_corpus

CASES = {
    # path: (base, folder, extension, stem, standard)
    "a/b/c.swift": ("c.swift", "a/b", "swift", "a/b/c", "a/b/c.swift"),
    "c.py": ("c.py", "", "py", "c", "c.py"),
    ".gitignore": (".gitignore", "", "", ".gitignore", ".gitignore"),
    "x/index.": ("index.", "x", "", "x/index.", "x/index."),
    "a//b///c.tar.gz/": ("c.tar.gz", "a/b", "gz", "a/b/c.tar", "a/b/c.tar.gz"),
    "/": ("/", "/", "", "/", "/"),
    "/x": ("x", "/", "", "/x", "/x"),
    "pkg/sub/../shared/util": ("util", "pkg/sub/../shared", "", "pkg/sub/../shared/util", "pkg/shared/util"),
    "../../x": ("x", "../..", "", "../../x", "../../x"),
    "a/../../b": ("b", "a/../..", "", "a/../../b", "../b"),
    "/a/../../b": ("b", "/a/../..", "", "/a/../../b", "/b"),
    "./a/./b.js": ("b.js", "./a/.", "js", "./a/./b", "a/b.js"),
    "win\\dir\\f.cs": ("f.cs", "win/dir", "cs", "win/dir/f", "win/dir/f.cs"),
}


def test_path_functions(spark):
    df = spark.createDataFrame([(p,) for p in CASES], "p string")
    p = F.col("p")
    rows = df.select(
        "p", paths.basename(p), paths.dirname(p), paths.extension(p), paths.stem(p), paths.standardize(p)
    ).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == CASES


def test_join_and_absolute(spark):
    df = spark.createDataFrame([("a/", "/b"), ("", "b"), ("a", ""), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(paths.join_path(F.col("x"), F.col("y"))).collect()] == ["a/b", "b", "a", "a/b"]
    df = spark.createDataFrame([("/usr",), ("C:/x",), ("c:\\x",), ("a/b",)], "x string")
    assert [r[0] for r in df.select(paths.is_absolute(F.col("x"))).collect()] == [True, True, True, False]


def test_layers(spark):
    cases = {
        "latest.py": "test", "inspector.py": "test", "gui/x.py": "ui", "ThingApp.swift": "entry", "src/main.c": "entry",
        "lib/store.py": "data", "webpack.js": "config", "a/b.py": "logic", "x/helper.go": "util", "x/parser.rs": "logic",
        "bin/x.py": "logic", "a/bin/x.py": "entry", "db/x.py": "data", "types.ts": "model", "http.c": "api",
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = df.select("p", scores.classify_layer(F.col("p"), F.array().cast("array<string>"))).collect()
    assert {r[0]: r[1] for r in got} == cases
    by_name = spark.createDataFrame([("a.py", ["drawBox"]), ("a.py", ["fetchAll"]), ("a.py", ["loadIt"]), ("a.py", ["x"])], "p string, n array<string>")
    got = by_name.select(scores.classify_layer(F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["ui", "api", "data", "logic"]


def test_scan_rules(spark, corpus_of):
    texts = {
        "a.py": "x", "node_modules/b.py": "x", "src/vendor/b.js": "x", "vendor.js": "x", ".hidden/a.py": "x", "a/.b.py": "x",
        "README.md": "x", "A.PY": "x", "tests/t.py": "x", "a/testing.go": "x", "big.c": "x" * 2_000_001, "edge.c": "x" * 2_000_000,
    }
    kept = {r.path for r in corpus_of(texts).collect()}
    assert kept == {"a.py", "vendor.js", "A.PY", "tests/t.py", "a/testing.go", "edge.c"}
    kept = {r.path for r in corpus_of(texts, include_tests=False).collect()}
    assert kept == {"a.py", "vendor.js", "A.PY", "edge.c"}
    assert {r.path for r in corpus_of(texts, max_files=2).collect()} == {"A.PY", "a.py"}


def test_decoding_and_newlines(spark):
    rows = [("r", "a", "u.py", "é\r\nx\ry".encode()), ("r", "a", "l.py", "é".encode("latin-1")), ("r", "a", "n.py", None)]
    raw = spark.createDataFrame(rows, "repo string, snap string, path string, content binary").withColumn("bytes", F.lit(5))
    got = {r.path: (r.content, r.lines) for r in read_corpus(raw).collect()}
    assert got == {"u.py": ("é\nx\ny", 3), "l.py": ("é", 1), "n.py": ("", 1)}


def test_numbers_in_words(spark):
    df = spark.createDataFrame([(999,), (1150,), (1250,), (1350,), (10500,), (11500,), (1_250_000,), (1_350_000,)], "n bigint")
    got = [r[0] for r in df.select(scores.compact_count(F.col("n"))).collect()]
    # the same digits a C library prints for the binary quotient
    expected = ["999"] + [f"{n / 1e3:.1f}k" for n in (1150, 1250, 1350)] + [f"{n / 1e3:.0f}k" for n in (10500, 11500)]
    assert got == expected + [f"{n / 1e6:.1f}M" for n in (1_250_000, 1_350_000)]


def test_difficulty(spark):
    df = spark.createDataFrame([(0, 0, 1), (3, 1, 20), (5, 2, 35), (20, 3, 100)], "b int, n int, s int")
    score = scores.difficulty_score(F.col("b"), F.col("n"), F.col("s"))
    got = df.select(score, scores.difficulty_band(score)).collect()
    assert [tuple(r) for r in got] == [(1, "easy"), (6, "moderate"), (11, "moderate"), (32, "hard")]


def test_roots_may_be_relative_or_below_a_skipped_name(spark, tmp_path, monkeypatch):
    from codetrellis.sources.corpus import oversized_files, read_tree

    for name, text in (("build/proj/a.py", "def a():\n    pass\n"), ("build/proj-b/c.py", "x = 1\n"), ("build/proj/node_modules/d.py", "y = 1\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    monkeypatch.chdir(tmp_path)
    for root in ("build/proj", "./build/proj/", f"{tmp_path}/build/proj", f"file://{tmp_path}/build/proj"):
        assert [r.path for r in read_tree(spark, root, "r", "s").collect()] == ["a.py"]
    assert read_tree(spark, "build/proj", "r", "s", max_bytes=None).count() == 1
    assert read_tree(spark, "build/proj", "r", "s", max_bytes=3).count() == 0
    files = spark.createDataFrame([("r", "s", "a.py", "12345"), ("r", "s", "b.py", "1")], "repo string, snap string, path string, content string")
    assert [tuple(r) for r in oversized_files(files, 3).collect()] == [("r", "s", "a.py", 5)]


def test_open_and_large_rankings(spark):
    from codetrellis.session import top_k

    rows = [("r", i % 50, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo string, score int, id int")
    order = [df["score"].desc(), "id"]
    expected = [r[2] for r in sorted(rows, key=lambda r: (-r[1], r[2]))]
    for k in (None, 1500, 7):
        got = {r.rank: r.id for r in top_k(df, ["repo"], order, k).collect()}
        assert [got[i + 1] for i in range(len(got))] == expected[:k]
