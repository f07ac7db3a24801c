"""Token counts of a unigram vocabulary by dynamic programming over a trie.

The distinct pre-tokens of a block of texts are put in a trie; each node, that is
each distinct prefix, gets the best score of any segmentation of the prefix
and its number of tokens, from the nodes above it, once for all pre-tokens that share it. A
text's count is the sum over its pre-tokens of what their last nodes hold.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.blocks import Rolling, blocks, text_bytes
from codetrellis.llm.registry import query, table


@dataclass(frozen=True)
class Unigrams:
    """A file of base64 tokens and ranks, and the pattern of pre-tokens.

    A token's score is ``-log(rank + 2)``: ranks of a merge vocabulary follow frequency.
    All single bytes must be tokens. Pre-tokens of more than ``longest`` bytes are
    segmented one by one instead of in the trie, with the same result.
    """

    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    longest: int = 40
    block_bytes: int = 8 << 20


def scores(ranks: str) -> dict[bytes, float]:
    with open(ranks, "rb") as lines:
        return {base64.b64decode(a): -math.log(int(b) + 2) for a, b in map(bytes.split, lines)}


def segment(word: bytes, score: dict[bytes, float], most: int) -> tuple[int, float]:
    """Number of tokens and score of the best segmentation; of equal scores, the fewest tokens."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        best.append(
            max(
                (best[i - n][0] + score[word[i - n : i]], best[i - n][1] - 1)
                for n in range(1, min(i, most) + 1)
                if word[i - n : i] in score
            )
        )
    return -best[-1][1], best[-1][0]


class Trie:
    """Scores and counts of many pre-tokens at once; tokens are found by 64-bit hash."""

    def __init__(self, score: dict[bytes, float], longest: int):
        self.score, self.longest, self.most = score, longest, max(map(len, score))
        self.rolling, self.tables = Rolling(21), {}
        for n in {len(t) for t in score}:
            if n <= longest:
                tokens = [t for t in score if len(t) == n]
                data = np.frombuffer(b"".join(tokens), np.uint8)
                at = np.arange(len(tokens)) * n
                names = self.rolling.stretch(self.rolling.prefix(data), at, at + n)
                order = np.argsort(names)
                self.tables[n] = names[order], np.array([score[t] for t in tokens])[order]

    def segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        counts, total = np.zeros(len(words), np.int64), np.zeros(len(words))
        sizes = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(sizes > self.longest):
            counts[i], total[i] = segment(words[i], self.score, self.most)
        short = np.array(sorted(np.flatnonzero(sizes <= self.longest), key=words.__getitem__), np.int64)
        if not len(short):
            return counts, total
        sizes = sizes[short]
        width = int(sizes.max())
        data = np.frombuffer(b"".join(words[i] for i in short), np.uint8)
        begin = np.cumsum(sizes) - sizes
        table = np.zeros((len(short), width), np.int16) - 1  # words in order, one byte a column
        row = np.repeat(np.arange(len(short)), sizes)
        table[row, np.arange(len(data)) - begin[row]] = data
        same = np.zeros((len(short), width), bool)
        same[1:] = (table[1:] == table[:-1]) & (table[1:] >= 0)
        shared = np.logical_and.accumulate(same, axis=1).sum(axis=1)  # bytes in common with the word before
        sums = self.rolling.prefix(data)
        # the word that owns the node of depth d on each word's path: the last one that made it new
        owner = np.zeros((width + 1, len(short)), np.int64)
        best = np.full((width + 1, len(short)), -np.inf)
        number = np.zeros((width + 1, len(short)), np.int64)
        best[0] = 0
        owner[0] = np.arange(len(short))
        for d in range(1, width + 1):
            fresh = (shared < d) & (sizes >= d)
            owner[d] = np.maximum.accumulate(np.where(fresh, np.arange(len(short)), 0))
            nodes = np.flatnonzero(fresh)
            top, fewest = np.full(len(nodes), -np.inf), np.zeros(len(nodes), np.int64)
            end = begin[nodes] + d
            for n in range(1, d + 1):
                if n not in self.tables:
                    continue
                names, values = self.tables[n]
                token = self.rolling.stretch(sums, end - n, end)
                at = np.minimum(np.searchsorted(names, token), len(names) - 1)
                above = owner[d - n][nodes]
                value = np.where(names[at] == token, best[d - n][above] + values[at], -np.inf)
                steps = number[d - n][above] + 1
                better = (value > top) | ((value == top) & (steps < fewest))
                top, fewest = np.where(better, value, top), np.where(better, steps, fewest)
            best[d][nodes], number[d][nodes] = top, fewest
        last = np.arange(len(short))
        counts[short] = number[sizes, owner[sizes, last]]
        total[short] = best[sizes, owner[sizes, last]]
        return counts, total


def count_tokens(docs: DataFrame, spec: Unigrams = Unigrams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, score`` of every row.

    Null texts are empty: no tokens, score 0. Of segmentations of equal score the one of
    fewest tokens counts. Rows are independent: repeated rows, null ids and other
    columns change nothing, an empty table gives no rows. Memory follows the
    distinct pre-tokens of a block of ``block_bytes``; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        trie, find = Trie(scores(spec.ranks), spec.longest), regex.compile(spec.pattern).findall
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in blocks(offsets, spec.block_bytes):
                parts = [find(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                distinct = list(set().union(*parts))
                counts, total = trie.segment([w.encode() for w in distinct])
                counts, total = dict(zip(distinct, counts.tolist())), dict(zip(distinct, total.tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(p) for p in parts], pa.int64()),
                        pa.array([sum(map(counts.__getitem__, p)) for p in parts], pa.int64()),
                        pa.array([math.fsum(map(total.__getitem__, p)) for p in parts], pa.float64()),
                    ],
                    ["doc_id", "n_pretokens", "n_tokens", "score"],
                )

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return docs.mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long, score double")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"))
