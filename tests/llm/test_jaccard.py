import random
import re

import numpy as np
import pytest

from codetrellis.llm.jaccard import Join, near_groups
from codetrellis.llm.links import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, num, den):
    rows = [(i, shingles(t, width)) for i, t in rows if i is not None]
    label = {}
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (_, x) in enumerate(rows):
        for b in range(a):
            y = rows[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    for a, (i, _) in enumerate(rows):
        label[find(a)] = min(i, label.get(find(a), i))
    return sorted((i, len(x), label[find(a)]) for a, (i, x) in enumerate(rows))


def corpus(seed, groups, most, length):
    draw = random.Random(seed)
    pool = ["w%d" % i for i in range(300)] + ["Été", "ÉTÉ", "The", "the"]
    rows, number = [], 0
    for _ in range(groups):
        base = [draw.choice(pool) for _ in range(draw.randint(1, length))]
        for _ in range(draw.randint(1, most)):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 5])):
                words[draw.randrange(len(words))] = draw.choice(pool)
            rows.append((number, draw.choice([" ", "\n", "\t "]).join(words)))
            number += 1
    draw.shuffle(rows)
    return rows


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "ONE"), (9006, "one two"), (9004, "one"), (None, "one")]


@pytest.mark.parametrize(
    "join",
    [
        Join(width=3, num=90, den=100),
        Join(width=5, num=80, den=100),
        Join(width=3, num=80, den=100, deletions=1.0),
        Join(width=3, num=80, den=100, deletions=0.5, together=500),
        Join(width=3, num=90, den=100, together=1),
        Join(width=3, num=80, den=100, few=1, expected=10**9, broadcast_rows=0),
        Join(width=3, num=70, den=100, few=2, deletions=0.25, expected=10**7),
    ],
)
def test_components_equal_brute_force(spark, join):
    rows = corpus(join.together + join.width, 40, 12, 120) + EDGES
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, f1 string, part string")
    found = sorted(tuple(r) for r in near_groups(docs, join).collect())
    assert found == brute(rows, join.width, join.num, join.den)


def test_empty_table(spark):
    assert near_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_connected_on_paths_and_stars(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5)]
    edges += [(draw.randrange(1000, 1200), draw.randrange(1000, 1200)) for _ in range(120)]
    found = dict(tuple(r) for r in connected(spark.createDataFrame(edges, "u long, v long")).collect())
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        if u != v:
            parent[b] = a
    assert found == {n: find(n) for n in parent if n != 5}


def test_a_frequent_signature_does_not_meet_in_one_group():
    """A third of all sets are near copies of one: a task hands on few of them under each signature."""
    from codetrellis.llm.jaccard import ENTRY, _split_hot

    draw = np.random.default_rng(2)
    entry = np.zeros(30_000, ENTRY)
    entry["s"], entry["f"] = draw.integers(0, 5000, 30_000), draw.integers(0, 1 << 40, 30_000)
    entry["s"][:10_000] = 7
    entry["r"] = draw.integers(0, 256, 30_000)
    bucket = (entry["s"] % 3).astype(np.int64)
    kept, where, hot = _split_hot(entry, bucket, 8)
    assert max(np.unique(kept["s"], return_counts=True)[1]) <= 8 + 8  # equal sets may come twice, in both forms
    names = {(int(b), int(s)) for s, b in zip(kept["s"][kept["h"] > 0], where[kept["h"] > 0])}
    assert names == {(int(v) >> 32, int(v) & 0xFFFFFFFF) for v in hot["v"]}
    # every set is in one of the two under its signature
    told = {(int(s), int(f)) for s, f in zip(kept["s"], kept["f"])} | {(int(v) & 0xFFFFFFFF, int(f)) for v, f in zip(hot["v"], hot["f"])}
    assert told == {(int(s), int(f)) for s, f in zip(entry["s"], entry["f"])}


def test_a_third_are_near_copies_and_one_row_repeats(spark):
    base = [f"w{i}" for i in range(120)]
    near = [(i, " ".join(base[:60] + [f"x{i}"] + base[61:])) for i in range(100)]
    rows = near + [(1000, "one row " * 3 + "that repeats")] * 100 + [(2000 + i, f"other{i} text{i} number{i} and{i} more{i}") for i in range(100)]
    rows += [(1001, "one row " * 3 + "that repeats")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = near_groups(docs, Join(width=3, num=90, den=100)).collect()
    assert len(found) == len(rows)
    groups = {r.doc_id: r.component_id for r in found}
    assert {groups[i] for i in range(100)} == {0} and groups[1000] == groups[1001] == 1000
    assert all(groups[2000 + i] == 2000 + i for i in range(100))
