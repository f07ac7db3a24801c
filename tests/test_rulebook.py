"""Rules given as rows."""

import pytest

from codetrellis.functions import rules as fixed
from codetrellis.functions.rulebook import RULE_ROWS, Rulebook, rules, using
from codetrellis.functions.scores import classify_layer, layer_rank
from codetrellis.plans.analysis import Analysis, Options
from codetrellis.sources.corpus import read_corpus
from pyspark.sql import functions as F

ZIG = [
    ("extension", "zig", "zig", 1),
    ("line comment", "zig", "//", 1),
    ("quote", "zig", '"', 1),
    ("function word", "zig", "fn", 1),
    ("type word", "zig", "struct", 1),
    ("layer", "wire", "interface", 2),
    ("layer path", "wire", "cable/", 1),
    ("forbidden layers", "wire", "data", 1),
]


def test_a_language_and_a_layer_by_rows_alone(spark):
    book = Rulebook.of_table(spark.createDataFrame(ZIG, RULE_ROWS))
    raw = [
        ("r", "s", "cable/a.zig", "// fn lost() {}\nfn one(a) {\n  if (a) { two(\"three()\"); }\n}\n"),
        ("r", "s", "store/b.zig", "fn two(a) { }\n"),
    ]
    raw = spark.createDataFrame(raw, "repo string, snap string, path string, content string")
    with using(book):
        files = read_corpus(raw)
    a = Analysis(files, Options(rules=book))
    assert sorted((r.path, r.name, r.branches) for r in a.symbols.collect()) == [("cable/a.zig", "one", 1), ("store/b.zig", "two", 0)]
    assert a.edges.count() == 1
    assert {r.path: r.layer for r in a.modules.collect()} == {"cable/a.zig": "wire", "store/b.zig": "data"}
    assert [r.kind for r in a.tables()["findings"].filter("kind = 'layerViolation'").collect()] == ["layerViolation"]
    assert read_corpus(raw).count() == 0  # the fixed values are as they were


def test_fixed_values_are_not_touched(spark):
    before = repr({k: getattr(fixed, k) for k in dir(fixed) if k.isupper()})
    book = Rulebook.of_rows([*ZIG, ("skipped directory", None, "attic", 1), ("line comment", "python", "##", 1), ("scope", "zig", "shape", 1)])
    with using(book):
        assert "attic" in rules.SKIPPED_DIRECTORIES and "zig" in rules.SHAPE_LANGUAGES
        assert [f[1] for f in rules.LEXICAL_FAMILIES.values() if "python" in f[0]] == [["##"]]
        row = spark.range(1).select(classify_layer(F.lit("x/cable/y"), F.array().cast("array<string>")).alias("l")).select(layer_rank(F.col("l")).alias("r"), "l").first()
        assert (row.l, row.r) == ("wire", 2)
        with using(Rulebook()):
            assert "attic" not in rules.SKIPPED_DIRECTORIES
    assert repr({k: getattr(fixed, k) for k in dir(fixed) if k.isupper()}) == before
    assert rules.SKIPPED_DIRECTORIES is fixed.SKIPPED_DIRECTORIES


def test_unknown_rules_are_errors():
    with pytest.raises(ValueError, match="colour"):
        Rulebook.of_rows([("colour", "a", "b", 1)])
