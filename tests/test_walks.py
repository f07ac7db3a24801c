"""Random small graphs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from codetrellis.operators import components, graph, routes, walks
from codetrellis.session import REPO_KEYS, distributed_rank

KEYS = ["repo"]


@pytest.fixture(scope="module")
def graphs(spark):
    random.seed(11)
    made, edges, nodes = {}, [], []
    for g in range(40):
        n = random.randint(2, 14)
        density = random.uniform(0.04, 0.4)
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b and random.random() < density]
        made[str(g)] = (n, pairs)
        edges += [(str(g), a, b, 1) for a, b in pairs]
        nodes += [(str(g), i) for i in range(n)]
    return (
        made,
        spark.createDataFrame(edges, "repo string, src bigint, dst bigint, n bigint"),
        spark.createDataFrame(nodes, "repo string, id bigint"),
    )


def following(n, pairs):
    out = [[] for _ in range(n)]
    for a, b in sorted(pairs):
        out[a].append(b)
    return out


def visited_in_order(out, start, limit):
    order, at = [start], 0
    while at < len(order) and len(order) < limit:
        order += [x for x in out[order[at]] if x not in order]
        at += 1
    return order


@pytest.mark.parametrize("limit", [400, 4])
def test_reach(graphs, limit):
    made, edges, nodes = graphs
    got = {
        (r.repo, r.source): (r.reach, r.capped)
        for r in walks.reach(edges, nodes.withColumnRenamed("id", "source"), KEYS, limit).collect()
    }
    for g, (n, pairs) in made.items():
        out = following(n, pairs)
        for i in range(n):
            seen = len(visited_in_order(out, i, limit))
            assert got[g, i] == (seen - 1, seen >= limit)


def test_reach_searches_only_for_large_and_cyclic_sets(spark, monkeypatch):
    # a part needs its half and its third; 50 and 51 need each other, 60 has an edge without an end, 70 needs 20 others
    pairs = [(i, j) for i in range(1, 48) for j in {i // 2, i // 3}] + [(50, 51), (51, 50), (52, 50), (60, None), (60, 3), (61, 60), (3, 3)]
    pairs += [(70, 100 + i) for i in range(20)]
    edges = spark.createDataFrame([("g", a, b, 1) for a, b in [*pairs, (None, 1)]], "repo string, src bigint, dst bigint, n bigint")
    names = [*{x for pair in pairs for x in pair}, 80]
    sources = spark.createDataFrame([("g", n) for n in names] * 2 + [(None, 1)], "repo string, source bigint")
    seen = walks.expand(edges, sources, KEYS, limit=12).groupBy("repo", "source").agg((F.count(F.lit(1)) - 1).alias("reach"))
    want = sorted(((r.repo, r.source, r.reach, r.reach >= 11) for r in seen.collect()), key=str)
    asked, expand = [], walks.expand

    def watched(edges, sources, *rest, **named):
        asked.append({(r.repo, r.source) for r in sources.collect()})
        return expand(edges, sources, *rest, **named)

    monkeypatch.setattr(walks, "expand", watched)
    got = walks.reach(edges, sources, KEYS, 12)
    assert sorted(((r.repo, r.source, r.reach, r.capped) for r in got.collect()), key=str) == want
    large = {("g", source) for repo, source, _, capped in want if capped and repo}
    assert large
    assert asked == [large | {("g", n) for n in (50, 51, 52, 60, 61, None)} | {(None, 1)}]


@pytest.mark.parametrize("direction", ["up", "down"])
def test_blast(graphs, direction):
    made, edges, nodes = graphs
    places = nodes.select("repo", F.col("id").alias("node"), (F.col("id") % 3).cast("string").alias("path"))
    sources = nodes.withColumnRenamed("id", "source")
    got = {
        (r.repo, r.source): (r.symbols, r.files)
        for r in walks.blast(edges, sources, places, KEYS, 2, direction, direction == "up").collect()
    }
    for g, (n, pairs) in made.items():
        out = following(n, pairs if direction == "down" else [(b, a) for a, b in pairs])
        for i in range(n):
            near = set(out[i]) | {y for x in out[i] for y in out[x]}
            near.discard(i)
            files = {x % 3 for x in near} | ({i % 3} if direction == "up" else set())
            assert got[g, i] == (len(near), len(files))


def test_components(graphs):
    made, edges, _ = graphs
    got = {}
    for r in components.components(edges, KEYS).collect():
        got.setdefault((r.repo, r.comp), set()).add(r.node)
    expected = set()
    for g, (n, pairs) in made.items():
        out = following(n, pairs)
        reached = [set(visited_in_order(out, i, 10**9)) for i in range(n)]
        for i in range(n):
            members = frozenset(j for j in reached[i] if i in reached[j])
            if len(members) > 1:
                expected.add((g, members))
    assert {(g, frozenset(m)) for (g, _), m in got.items()} == expected
    assert all(comp == max(m) for (_, comp), m in got.items())


def test_depth(graphs):
    made, edges, nodes = graphs
    got = {(r.repo, r.id): r.depth for r in walks.depth(nodes, edges, KEYS).collect()}
    for g, (n, pairs) in made.items():
        ends = [set(range(n))]
        for _ in range(5):
            ends.append({b for a, b in pairs if a in ends[-1]})
        for i in range(n):
            assert got[g, i] == max(k for k in range(6) if i in ends[k])


def test_chains(graphs):
    made, edges, nodes = graphs
    got = {(r.repo, r.id): (list(r.path), r.rooted) for r in walks.chains(nodes, edges, KEYS).collect()}
    for g, (n, pairs) in made.items():
        callers = [sorted(a for a, b in pairs if b == i) for i in range(n)]
        for i in range(n):
            # all simple paths to a root, shortest first, then by the callers nearest the target
            best, level = None, [[i]]
            while level and best is None:
                ends = [p for p in level if not callers[p[-1]]]
                if ends:
                    best = min(ends)
                level = [p + [c] for p in level if len(p) <= 8 for c in callers[p[-1]] if c not in p]
            assert got[g, i] == ((best[::-1], True) if best else ([i], False))


def test_closure_and_highlight(graphs):
    made, edges, nodes = graphs
    sources = nodes.filter("id = 0").withColumnRenamed("id", "source")
    down, lit = {}, {}
    for r in walks.closure(edges, sources, KEYS).collect():
        down.setdefault(r.repo, set()).add(r.node)
    for r in walks.highlighted(edges, sources, KEYS).collect():
        lit.setdefault(r.repo, set()).add(r.node)
    for g, (n, pairs) in made.items():
        below = set(visited_in_order(following(n, pairs), 0, 10**9))
        above = set(visited_in_order(following(n, [(b, a) for a, b in pairs]), 0, 10**9))
        assert down.get(g, set()) == below - {0}
        assert lit[g] == below | above


def test_route(spark, graphs):
    made, edges, nodes = graphs
    both = edges.withColumn("snap", F.lit("a"))
    shaped = nodes.select(
        "repo",
        F.lit("a").alias("snap"),
        F.col("id").alias("sym_id"),
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") % 5 == 4, "test/x.py").when(F.col("id") % 2 == 0, "src/a.py").otherwise("b/c.py").alias("path"),
        F.when(F.col("id") % 7 == 6, "type").when(F.col("id") % 7 == 5, "initializer").otherwise("function").alias("kind"),
        F.lit(False).alias("is_external"),
        (F.col("id") % 9 + 1).cast("int").alias("span"),
    )
    symbols = graph.with_degrees(shaped, both, REPO_KEYS, "sym_id")
    got = {}
    for r in routes.route(symbols, both).collect():
        got.setdefault(r.repo, {})[r.step] = (r.sym_id, r.reached_from)
    for g, (n, pairs) in made.items():
        out = following(n, pairs)
        calls = [len(out[i]) for i in range(n)]
        called = [sum(1 for _, b in pairs if b == i) for i in range(n)]
        path = ["test/x.py" if i % 5 == 4 else "src/a.py" if i % 2 == 0 else "b/c.py" for i in range(n)]
        readable = [i % 5 != 4 and i % 7 != 6 for i in range(n)]

        def step_value(i, before):
            value = min(calls[i], 12) * 4 + min(called[i], 6) + (6 if i % 9 + 1 >= 6 else -10)
            value += -25 * (calls[i] == 0) + 12 * path[i].startswith("src/") + 8 * (path[i] == path[before])
            return value - 4 * (i % 7 == 5)

        def entry_value(i):
            value = min(40, 2 * min(10, calls[i]) + sum(min(4, calls[x]) for x in out[i][:12]))
            return value + 45 * (called[i] == 0) + 20 * path[i].startswith("src/") - 15 * (i % 9 + 1 < 4)

        starts = [i for i in range(n) if readable[i] and calls[i] > 0]
        if not starts:
            assert g not in got
            continue
        start = min(starts, key=lambda i: (-entry_value(i), i))
        expected, at = [(start, None)], start
        while len(expected) < 6:
            taken = {s for s, _ in expected}
            options = [i for i in out[at] if i not in taken and readable[i] and (len(expected) == 5 or calls[i] > 0)]
            if not options:
                break
            chosen = min(options, key=lambda i: (-step_value(i, at), i))
            expected.append((chosen, at))
            at = chosen
        if len(expected) < 4:
            taken = {s for s, _ in expected}
            spare = sorted((i for i in out[start] if i not in taken and readable[i]), key=lambda i: (-step_value(i, start), i))
            expected += [(i, start) for i in spare[: 6 - len(expected)]]
        assert got[g] == dict(enumerate(expected, 1))


def test_distributed_rank_with_one_huge_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, F.col("id").cast("string")).otherwise("hot").alias("g"), (F.col("id") * 7919 % 5003).alias("x")
    )
    ranked = distributed_rank(rows, ["g"], ["x"], "at").collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.g, []).append((r.x, r.at))
    assert sum(map(len, groups.values())) == 5000
    for members in groups.values():
        assert [at for _, at in sorted(members)] == list(range(len(members)))
