"""The trie of conversation prefixes against a trie of plain dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetrellis.llm import prefix_trie as trie
from codetrellis.llm.prefix_trie import Blocks, Minima


def test_sparse_table_answers_like_a_scan():
    draw = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 65):
        values = draw.integers(-1, 5, n)
        table = Minima(values)
        start, depth = draw.integers(0, n + 1, 200), draw.integers(-1, 7, 200)
        for s, d, r in zip(start, depth, table.right(start, depth)):
            assert r == next((i for i in range(s, n) if values[i] < d), n)
        end = np.minimum(start, n - 1)
        for e, d, p in zip(end, depth, table.left(end, depth)):
            assert p == next((i for i in range(e, -1, -1) if values[i] < d), -1)
        stop = draw.integers(0, n + 1, 200)
        low = table.least(np.minimum(start, stop), np.maximum(start, stop))
        for a, b, v in zip(np.minimum(start, stop), np.maximum(start, stop), low):
            assert v == (values[a:b].min() if b > a else np.iinfo(np.int64).max)


def brute_rows(sequences):
    """The rows of the contract from {conv_id: [(role, text), ...]}."""
    members, ends = {}, {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def brute_rebuilt(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    held = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in held.items()}
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = held.get(c - c % 5, [])[:h] + own[h:]
    return out


def found_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def conversations(draw, n, turns=6, words=2):
    rows = []
    for c in range(n):
        for t in range(draw.randint(1, turns)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice("aé")[:1] * draw.randint(0, words)))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1 << 14])
def test_any_block_size_equals_plain_python(spark, size):
    rows = conversations(random.Random(size), 90)
    convs = trie.rebuilt(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert found_rows(trie.prefix_trie(convs, Blocks(size=size))) == brute_rows(brute_rebuilt(rows))


def test_blocks_grow_when_there_may_be_few(spark):
    rows = conversations(random.Random(8), 60)
    convs = trie.rebuilt(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert Blocks(size=1, most=4).step(10) == 3
    assert found_rows(trie.prefix_trie(convs, Blocks(size=1, most=4))) == brute_rows(brute_rebuilt(rows))


def test_nulls_ties_repeats_and_further_columns(spark):
    rows = [(0, None, None, None), (0, 1, "user", "x"), (0, 1, "user", "x"), (0, 1, "assistant", "y"), (1, 0, None, ""), (None, 0, "user", "lost")]
    rows += [(2, 0, "", None), (3, 5, "user", "z" * 300), (3, 5, "user", "z" * 299), (7, 0, "user", "only"), (10, 2, "é", "é" * 70)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", name string, d string")
    expected = brute_rows(brute_rebuilt(rows))
    # two texts with equal beginnings and one turn are ordered by name; their order is free
    found = found_rows(trie.prefix_trie(trie.rebuilt(trie.numbered_turns(df)), Blocks(size=2)))
    assert [r[:6] for r in found] == [r[:6] for r in expected]
    assert max(r[6] for r in found) == max(r[6] for r in expected)


def test_turnless_conversations_and_empty_tables(spark):
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(lone, 0, "user", "a"), (lone, 1, "user", "b")]
    convs = trie.rebuilt(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert found_rows(trie.prefix_trie(convs)) == brute_rows({lone: []})
    nothing = trie.numbered_turns(spark.createDataFrame([], SCHEMA))
    assert trie.prefix_trie(trie.rebuilt(nothing)).count() == 0


def test_a_third_are_copies_and_one_conversation_is_long(spark):
    draw = random.Random(4)
    rows = [(c, t, "user", f"hot {t}") for c in range(0, 300) for t in range(3)]
    rows += [(c, t, "user", f"{draw.random()}") for c in range(300, 500) for t in range(draw.randint(1, 4))]
    rows += [(1000, t, "user", f"long {t}") for t in range(700)]
    convs = trie.rebuilt(trie.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert found_rows(trie.prefix_trie(convs, Blocks(size=16))) == brute_rows(brute_rebuilt(rows))


def test_digest_of_many_members_runs_over_chunks(spark):
    members = spark.range(5000).select(F.lit("a").alias("class"), F.col("id").alias("conv_id"))
    members = members.unionByName(spark.createDataFrame([("b", -7)], "class string, conv_id long"))
    found = {r[0]: r[1] for r in trie.member_digests(members, ids_a_chunk=7).collect()}
    assert found == {
        "a": hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest(),
        "b": hashlib.sha256(b"-7").hexdigest(),
    }


def test_query_reads_the_table(spark, tmp_path):
    rows = conversations(random.Random(77), 40)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found_rows(trie.op13_prefix_trie(spark, str(tmp_path))) == brute_rows(brute_rebuilt(rows))
