"""Cycles by contraction, and the reachability index, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codetrellis.operators import components, reachability

KEYS = ["repo"]
EDGES = "repo string, src bigint, dst bigint"


def closure(n, pairs):
    out = [set() for _ in range(n)]
    for a, b in pairs:
        out[a].add(b)
    seen = []
    for i in range(n):
        found, todo = set(), list(out[i])
        while todo:
            x = todo.pop()
            if x not in found:
                found.add(x)
                todo += out[x]
        seen.append(found)
    return seen


def many(seed, graphs, most, thin=0.03, thick=0.3):
    draw = random.Random(seed)
    made = {}
    for g in range(graphs):
        n = draw.randint(2, most)
        p = draw.uniform(thin, thick)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and draw.random() < p]
        # long runs and rings among the random edges
        pairs += [(i, i + 1) for i in range(draw.randint(0, n - 1))]
        if draw.random() < 0.4:
            pairs.append((n - 1, draw.randint(0, n - 1)))
        made[str(g)] = (n, sorted({(a, b) for a, b in pairs if a != b}))
    return made


def table(spark, made):
    return spark.createDataFrame([(g, a, b) for g, (_, pairs) in made.items() for a, b in pairs], EDGES)


@pytest.mark.parametrize(("seed", "most", "thick"), [(1, 10, 0.3), (2, 25, 0.08), (3, 40, 0.04)])
def test_components_of_random_graphs(spark, seed, most, thick):
    made = many(seed, 60, most, 0.0, thick)
    found = {}
    for r in components.components(table(spark, made), KEYS).collect():
        found.setdefault((r.repo, r.comp), set()).add(r.node)
    expected = {}
    for g, (n, pairs) in made.items():
        seen = closure(n, pairs)
        for i in range(n):
            members = {j for j in seen[i] if i in seen[j]} | {i}
            if len(members) > 1:
                expected[g, max(members)] = members
    assert found == expected


def test_rings_and_runs(spark):
    ring = [("ring", i, (i + 1) % 50) for i in range(50)]
    two = [("two", 0, 1), ("two", 1, 0), ("two", 1, 2), ("two", 2, 3), ("two", 3, 1), ("two", 3, 4), ("two", 5, 0)]
    loop = [("loop", 7, 7), ("loop", 7, 8), ("loop", 8, 9), ("loop", 7, 8)]
    eight = [("eight", a, b) for a, b in [(0, 1), (1, 2), (2, 0), (0, 3), (3, 4), (4, 0)]]
    found = {}
    for r in components.components(spark.createDataFrame(ring + two + loop + eight, EDGES), KEYS).collect():
        found.setdefault((r.repo, r.comp), []).append(r.node)
    assert {k: sorted(v) for k, v in found.items()} == {
        ("ring", 49): list(range(50)), ("two", 3): [0, 1, 2, 3], ("eight", 4): [0, 1, 2, 3, 4]
    }
    assert components.components(spark.createDataFrame([], EDGES), KEYS).count() == 0


def test_a_chain_of_cycles_takes_rounds_by_its_logarithm(spark, monkeypatch):
    written = []
    whole = components.cut
    monkeypatch.setattr(components, "cut", lambda df: written.append(1) or whole(df))
    rounds = {}
    for n in (90, 9_000):
        rows = spark.range(n).select(
            F.lit("a").alias("repo"), F.col("id").alias("src"),
            F.explode(F.array(F.when(F.col("id") % 3 < 2, F.col("id") + 1).otherwise(F.col("id") - 2), F.when(F.col("id") % 3 == 2, F.col("id") + 1))).alias("dst"),
        ).filter(f"dst IS NOT NULL AND dst < {n}")
        written.clear()
        found = components.components(rows, KEYS)
        sizes = found.groupBy("comp").count().filter("count = 3").count()
        rounds[n] = len(written)
        assert sizes == n // 3
    # a hundred times as long: the doubling of two chains takes some seven steps more each
    assert rounds[9_000] <= rounds[90] + 40


@pytest.mark.parametrize("seed", [4, 5])
def test_index_answers_every_question(spark, seed):
    made = many(seed, 25, 18)
    edges = table(spark, made)
    nodes = spark.createDataFrame([(g, i) for g, (n, _) in made.items() for i in range(n)], "repo string, node bigint")
    found = reachability.index(nodes, edges, KEYS)
    seen = {g: closure(n, pairs) for g, (n, pairs) in made.items()}
    sizes = {(r.repo, r.source): r.reach for r in reachability.reach_sizes(found).collect()}
    assert sizes == {(g, i): len(s[i] - {i}) for g, s in seen.items() for i in range(len(s))}
    pairs = nodes.withColumnRenamed("node", "source").join(nodes.withColumnRenamed("node", "target"), "repo")
    for r in reachability.reaches(found, pairs).collect():
        assert r.reachable == (r.target in seen[r.repo][r.source])


def test_index_is_written_and_read_back(spark, tmp_path):
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 2), ("b", 1, 2)], EDGES)
    nodes = spark.createDataFrame([("a", 9), ("c", 1)], "repo string, node bigint")
    reachability.index(nodes, edges, KEYS).save(str(tmp_path))
    found = reachability.Index.load(spark, str(tmp_path), KEYS)
    asked = [("a", 1, 3), ("a", 3, 1), ("a", 2, 2), ("a", 1, 1), ("b", 1, 2), ("b", 2, 1), ("c", 1, 1), ("d", 1, 2), ("a", 1, 3)]
    pairs = spark.createDataFrame(asked, "repo string, source bigint, target bigint")
    got = sorted((r.repo, r.source, r.target, r.reachable) for r in reachability.reaches(found, pairs).collect())
    assert got == sorted((*q, q in {("a", 1, 3), ("a", 2, 2), ("b", 1, 2)}) for q in asked)
    assert {(r.repo, r.source): r.reach for r in reachability.reach_sizes(found).collect()} == {
        ("a", 1): 2, ("a", 2): 1, ("a", 3): 1, ("a", 9): 0, ("b", 1): 1, ("b", 2): 0, ("c", 1): 0
    }


def test_a_long_path_is_one_chain(spark):
    path = spark.range(3000).select(F.lit("a").alias("repo"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = reachability.index(spark.createDataFrame([], "repo string, node bigint"), path, KEYS)
    assert found.rounds == 1 and found.reached.count() == 3001
    assert {r.source: r.reach for r in reachability.reach_sizes(found).collect()} == {i: 3000 - i for i in range(3001)}
