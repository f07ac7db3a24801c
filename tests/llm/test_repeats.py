import random

import numpy as np
import pytest

from codetrellis.llm.repeats import Repeats, remove_repeats, sliding_minimum, window_ranks


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        edges = [i for i in range(len(t) + 1) if (i < len(t) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((len(t), list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(t, gone) if not g)))
    return out


def corpus(seed):
    draw = random.Random(seed)
    pool = ["ba", "xe", "é", "ß ", "\n", " the ", "漢", "q", "zz "]

    def piece(n):
        return "".join(draw.choice(pool) for _ in range(n))

    shared = [piece(draw.randint(3, 60)) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = [draw.choice(shared) if draw.random() < 0.4 else piece(draw.randint(0, 40)) for _ in range(draw.randint(0, 6))]
        texts.append("".join(parts))
    texts += [texts[3]] * 5 + ["ab" * 100, "ab" * 30 + "x", "", None, "a" * 300, "short"]
    return texts


@pytest.mark.parametrize(
    "spec",
    [
        Repeats(length=20, gram=8, chunk_bytes=600),
        Repeats(length=20, gram=20, chunk_bytes=600),
        Repeats(length=21, gram=4, chunk_bytes=600, phrases=2, own=2),
        Repeats(length=21, gram=3, chunk_bytes=5000, phrases=0, own=1),
        Repeats(length=40, gram=16),
    ],
)
def test_same_as_brute_force(spark, spec):
    texts = corpus(spec.length + spec.gram)
    rows = [(i if i % 17 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    found = [
        (r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(docs, spec).collect()
    ]
    expected = [(r[0], *x) for r, x in zip(rows, brute([(t or "").encode() for t in texts], spec.length))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sliding_minimum_and_ranks():
    x = np.random.default_rng(1).integers(0, 50, 97).astype(np.uint64)
    for width in (1, 2, 5, 96, 97, 98):
        assert sliding_minimum(x, width).tolist() == [min(x[i : i + width]) for i in range(97 - width + 1)]
    data = np.random.default_rng(2).integers(97, 99, 200).astype(np.uint8)
    for length in (1, 5, 8, 13, 40):
        ranks = window_ranks(data, length)[: 201 - length]
        names = [data[i : i + length].tobytes() for i in range(201 - length)]
        order = {s: i for i, s in enumerate(sorted(set(names)))}
        assert np.argsort(ranks, kind="stable").tolist() == np.argsort([order[s] for s in names], kind="stable").tolist()
