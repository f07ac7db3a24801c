"""Runs of repeated words against all lags in plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrellis.llm import periodic
from codetrellis.llm.periodic import Periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6):
    """(start, length, period) of all runs, from all lags."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 4 * q):
                best.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_words(draw):
    words = []
    for _ in range(draw.randint(0, 6)):
        size = draw.choice([1, 2, 3, 5, 8, 9, 12, 16, 17, 20, 32, 33, 40])
        letters = draw.choice(["ab", "abcdefgh"])
        base = [draw.choice(letters) for _ in range(size)]
        words += (base * draw.randint(1, 7))[: draw.randint(1, size * 7)]
        if draw.random() < 0.3:
            words += [draw.choice("ab") for _ in range(draw.randint(0, 30))]
    return words


def test_runs_equal_all_lags_on_random_words():
    draw = random.Random(5)
    for direct in (1, 2, 8):
        for _ in range(150):
            texts = [some_words(draw) for _ in range(4)]
            runs, bounds, left = periodic._block([" ".join(t).encode() for t in texts], Periodic(direct=direct))
            for i, words in enumerate(texts):
                assert [tuple(r) for r in runs[bounds[i] : bounds[i + 1]].tolist()] == brute(words)
                assert left[i] == collapsed(words, brute(words))


@pytest.mark.parametrize("period", [1, 7, 8, 9, 64, 65, 1000, 4097])
def test_every_scale_finds_its_period(period):
    draw = np.random.default_rng(period)
    base = draw.integers(0, 50 + period, period)
    while period > 1 and len(set(base)) == 1:
        base = draw.integers(0, 50, period)
    inside = np.tile(base, 6)[: 4 * period + max(2, period // 3)]
    x = np.concatenate([draw.integers(10**6, 10**9, 33), inside, draw.integers(10**6, 10**9, 21), [-1]])
    found = periodic.find_runs(x.astype(np.int64), len(x), Periodic()).tolist()
    smallest = next(q for q in range(1, period + 1) if (inside[q:] == inside[:-q]).all())
    assert [33, 33 + len(inside), smallest] in found


def test_fibonacci_and_thue_morse_words():
    a, b = "a", "ab"
    while len(b) < 1500:
        a, b = b, b + a
    cubes = [bin(i).count("1") % 2 for i in range(1024)]
    for words in (list(b), ["ab"[c] for c in cubes], ["ab"[c] for c in cubes] * 5, list("aab") * 300 + list(b) * 4):
        runs, _, _ = periodic._block([" ".join(words).encode()], Periodic())
        assert [tuple(r) for r in runs.tolist()] == brute(words)


def test_words_of_hidden_hash_collisions_are_looked_at(monkeypatch):
    """With a hash of four values the words themselves still decide."""
    weak = periodic.mixed
    monkeypatch.setattr(periodic, "mixed", lambda x, salt=0: weak(x, salt) & np.uint64(3))
    draw = random.Random(9)
    for _ in range(30):
        words = some_words(draw)
        runs, _, _ = periodic._block([" ".join(words).encode()], Periodic())
        assert {tuple(r) for r in runs.tolist()} <= set(brute(words))


def test_columns_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a a a a a a a", 7), (1, "a a a a a a a", 7), (None, "x y " * 9, 8), (2, None, 9), (3, "", None), (4, "a\tb\x0bc\xa0d", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    found = Counter((r.doc_id, r.start, str([tuple(x) for x in r.runs]), r.collapsed) for r in periodic.collapse_runs(docs).collect())
    assert found == Counter([
        (1, 7, "[(0, 7, 1)]", "a"), (1, 7, "[(0, 7, 1)]", "a"), (None, 8, "[(0, 18, 2)]", "x y"),
        (2, 9, "[]", ""), (3, None, "[]", ""), (4, 1, "[]", "a b c\xa0d"),
    ])
    empty = docs.limit(0)
    assert periodic.collapse_runs(empty).count() == 0
    clash = periodic.collapse_runs(docs.withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("mine")))
    assert clash.columns == ["doc_id", "start", "runs", "collapsed"] and {r.collapsed for r in clash.collect()} == {"a", "x y", "", "a b c\xa0d"}


def test_long_text(spark):
    draw = random.Random(1)
    base = ["w%d" % draw.randint(0, 30_000) for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(["z"] * 5 + base * 4 + base[:17]))], "doc_id long, text string")
    row = periodic.collapse_runs(docs).first()
    assert (5, 240_017, 60_000) in [tuple(r) for r in row.runs]
    assert row.collapsed.split() == ["z"] * 5 + base


def expected_row(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a, = (g % n,)
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())


def test_query_equals_plain_python(spark, tmp_path):
    draw = random.Random(2)
    texts = [None, "", " \n", "one", "a a a a a a"] + [" ".join(some_words(draw)) for _ in range(60)]
    texts += [" ".join("w%d" % draw.randint(0, 400) for _ in range(draw.randint(1, 300))) for _ in range(140)]
    rows = list(enumerate(texts))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = periodic.op12_periodic_runs(spark, str(tmp_path)).collect()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r[n] for n in names) for r in found) == [expected_row(i, t) for i, t in rows]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
