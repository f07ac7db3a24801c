"""Merge-rank encoding against the tokenizer library itself, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from codetrellis.llm import merges

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def texts():
    draw = random.Random(3)
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "hello", "Σ", "ΑΣ", " ", "'s", "'LL", "don't", "́", "İ", "‍", "\U0001f600", "1", "\x1c", "\x85"]
    found = [None, "", " \n\t", "Don't  STOP\x1cnow 1234", "a" * 3000, "ab" * 3000, "the" * 2000, "x́" * 500]
    for _ in range(400):
        found.append("".join(chr(draw.choice(points)) for _ in range(draw.randint(0, 40))))
        found.append("".join(draw.choice(parts) for _ in range(draw.randint(0, 25))))
        found.append("".join(draw.choice("abcdeAÄé'́ \t\x1c\x1f\x85 sStT1 2<|>endoftext") for _ in range(draw.randint(0, 80))))
    return found + ["".join(draw.choice("abc") for _ in range(50_000))]


def test_ids_and_texts_equal_the_library(spark):
    rows = [(i, t, "kept") for i, t in enumerate(texts())] + [(None, "a null id", "kept"), (3, texts()[3], "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = merges.decode(merges.encode(docs)).collect()
    expected = []
    for i, t, lang in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        expected.append((str(i), lang, np.array(ids, "<u4").tobytes(), len(ids), LIBRARY.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.lang, bytes(r.ids), r.n_tokens, r.decoded) for r in found) == sorted(expected)


def test_what_is_remembered_does_not_change_the_ids():
    some = [t or "" for t in texts()[:300]]
    small, large = merges.Encoder(merges.Merging(chunk=3, remembered=2000)), merges.Encoder(merges.Merging())
    assert [small.encode(t) for t in some] == [large.encode(t) for t in some]


def test_stale_entries_are_skipped():
    merger = merges.Encoder(merges.Merging()).merger
    for word in ["aaaaaaa", "abababababab", "lowerlowerlower", "x" * 999]:
        assert merger.merge(word.encode()) == LIBRARY.encode(word, add_special_tokens=False).ids


def test_white_space_is_that_of_the_file():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = pre_tokenizers.Split(Regex(r"\s"), "removed", invert=True)
    spaces = {x for i in range(0, len(every), 20_000) for x, _ in split.pre_tokenize_str("".join(every[i : i + 20_000]))}
    assert {c for part in spaces for c in part} == {c for c in every if merges.SPACE.fullmatch(c)}
    assert {c for c in every if c.isspace()} - {c for part in spaces for c in part} == set("\x1c\x1d\x1e\x1f")


def test_clashing_columns_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    out = merges.decode(merges.encode(empty))
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded"] and out.count() == 0
    clash = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id long, text string, decoded string, ids int").withColumn("n_tokens", F.lit(-1))
    row = merges.decode(merges.encode(clash)).first()
    assert (row.n_tokens, row.decoded, sorted(row.asDict())) == (2, "a</w> b</w>", ["decoded", "doc_id", "ids", "n_tokens"])


def test_unknown_ids_are_left_out(spark):
    row = spark.createDataFrame([(bytearray(np.array([0, 99_999, 49_407], "<u4").tobytes()),), (None,)], "ids binary")
    assert [r.decoded for r in merges.decode(row).collect()] == ["! <|endoftext|>", ""]


def test_query_gives_digests_of_the_library(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in merges.op11_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = LIBRARY.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
