"""Strings that a polynomial modulo 2^64 cannot tell apart, whatever its base."""

import numpy as np
import pytest

from codetrellis.llm import stages
from codetrellis.llm.blocks import Rolling, word_hashes
from codetrellis.llm.jaccard import Join, near_groups
from codetrellis.llm.repeats import Repeats, remove_repeats


def pair(n):
    """The Thue-Morse word of n letters and its complement."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = [512, 1024, 2048]


@pytest.mark.parametrize("n", SIZES)
def test_word_hashes_tell_them_apart(n):
    data = np.frombuffer("".join(pair(n)).encode(), np.uint8)
    start, end = np.array([0, n]), np.array([n, 2 * n])
    rolling = Rolling(1)
    for lanes in (1, 16, 1000):
        assert len(set(word_hashes(data, start, end, 0, lanes).tolist())) == 2
    if n >= 1024:  # else the strings prove nothing
        assert len(set(rolling.stretch(rolling.prefix(data), start, end).tolist())) == 1


def test_word_hashes_depend_on_the_bytes_alone():
    words = [b"", b"a", b"b", b"abcdefg", b"abcdefgh", b"abcdefghi", b"x" * 127, b"x" * 128, b"x" * 129, b"a\x00", b"a\x00\x00"]
    data = np.frombuffer(b"##".join(words + words), np.uint8)
    ends = np.cumsum([len(w) + 2 for w in words + words]) - 2
    starts = ends - [len(w) for w in words + words]
    found = word_hashes(data, starts, ends)
    assert (found[: len(words)] == found[len(words) :]).all() and len(set(found.tolist())) == len(words)


def test_texts_of_such_words_are_not_linked(spark):
    rows = [(10 * i + j, w) for i, n in enumerate(SIZES) for j, w in enumerate(pair(n))]
    rows += [(100 + i, " ".join(pair(n) * 2)) for i, n in enumerate(SIZES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(docs, Join(width=3, num=90, den=100)).collect()}
    assert found == {i: (1 if i < 100 else 2, i) for i, _ in rows}


def test_the_near_duplicate_stage_keeps_them(spark):
    rows = [(i, w, "en", "s", len(w)) for i, w in enumerate(pair(1024) + pair(2048))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert stages.near_duplicates(spark, docs, "").count() == len(rows)


def test_long_repeats_are_told_apart(spark):
    rows = [(i, w) for i, w in enumerate(pair(512) + pair(1024) + pair(2048))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    length = 600
    seen = {}
    for i, t in rows:
        for at in range(len(t) - length + 1):
            seen.setdefault(t[at : at + length], []).append((i, at))
    covered = {}
    for places in seen.values():
        if len(places) > 1:
            for i, at in places:
                covered.setdefault(i, set()).update(range(at, at + length))
    found = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in remove_repeats(docs, Repeats(length=length)).collect()}
    assert found == {i: len(covered.get(i, ())) for i, _ in rows}
    with pytest.raises(ValueError, match="gram"):
        remove_repeats(docs, Repeats(length=600, gram=600))


def test_copies_of_one_row_are_dealt_to_many_chunks(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text)] * 60 + [(i, f"{i} " * 40) for i in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    found = remove_repeats(docs, Repeats(chunk_bytes=1000)).collect()
    assert len(found) == len(rows) and all(r.kept == b"" for r in found if r.doc_id == 1)
