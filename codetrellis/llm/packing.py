"""Best-fit packing of token pieces into sequences of a fixed length.

A piece is a vector (tokens, one document, attention cost = tokens squared). All
pieces of one length are the same vector, so the whole corpus is described by
how many pieces each length has: at most ``capacity`` counts, whatever the data.
Best-fit decreasing runs on those counts, on groups of bins that are alike, and
gives slots; Spark deals the pieces out to the slots of their length by rank.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut

PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _seen long"


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold; ``weights`` say how much each residual counts in the choice."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    #: "norm" keeps the smallest weighted residual, "dot" the largest weighted dot product
    choice: str = "norm"


@dataclass(frozen=True)
class Vocabulary:
    """Files of one byte-level vocabulary; ``ranks`` has the same ids as ``tokenizer``."""

    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json")
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern: str = public_tokenizers.PATTERN
    special: tuple[str, ...] = ("<|endoftext|>",)
    separator: int = 0
    #: longer texts go to the slower library, which has no limit on a match
    longest: int = 1_000_000


def encoder(vocabulary: Vocabulary):
    """A function from text to ids (little-endian uint32 bytes).

    Texts with a special string, and very long ones, go through the tokenizer
    file itself; all others through the rank file, which gives the same ids.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(vocabulary.ranks, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})
    slow = []

    def encode(text: str) -> bytes:
        if len(text) > vocabulary.longest or any(s in text for s in vocabulary.special):
            if not slow:
                slow.append(Tokenizer.from_file(vocabulary.tokenizer))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(fast.encode_ordinary(text), "<u4").tobytes()

    return encode


def pieces(docs: DataFrame, capacity: int, vocabulary: Vocabulary = Vocabulary(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's token pieces of at most ``capacity``: PIECE_FIELDS.

    A text is its ids and the separator; null texts count as empty and so have
    length 1. Longer texts are cut from the end, the first piece is the short one.
    ``_seen`` counts the earlier pieces of that length in the same task, so no
    shuffle is needed to number the pieces of a length later.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(vocabulary), {}
        end = np.array([vocabulary.separator], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                total, start, number = len(ids) // 4, 0, 0
                while start < total:
                    length = (total - start) % capacity or capacity
                    n = seen.get(length, 0)
                    seen[length] = n + 1
                    crc = zlib.crc32(memoryview(ids)[4 * start : 4 * (start + length)])
                    out.append((doc_id, number, start, length, crc, task, n))
                    start, number = start + length, number + 1
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_seen"],
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECE_FIELDS)


def best_fit(counts: dict[int, int], capacities: Capacities) -> np.ndarray:
    """Slots that hold ``counts[length]`` pieces of every length, by best-fit decreasing.

    Bins of equal content are one group with a multiplicity, and a length's pieces
    go to the best group until it is used up, so the work depends on the number of
    distinct lengths L only: at most 3 L groups of at most sqrt(2 * tokens) runs.
    Rows: length, first rank, first sequence, pieces per sequence, offset.
    """
    full = np.array([capacities.tokens, capacities.documents, capacities.attention], np.int64)
    weights = np.array(capacities.weights) / full
    residual, many, runs = np.zeros((0, 3), np.int64), [], []  # of the open groups

    def fits(space, item):
        return int(min(space[d] // item[d] for d in range(3)))

    done: list[tuple[int, list]] = []
    for length in sorted(counts, reverse=True):
        left, item = int(counts[length]), np.array([length, 1, length * length], np.int64)
        if fits(full, item) < 1:
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        while left:
            able = np.flatnonzero((residual >= item).all(axis=1))
            if len(able):
                after = (residual[able] - item) * weights
                if capacities.choice == "norm":
                    best = able[np.argmin((after * after).sum(axis=1))]
                else:
                    space = residual[able] * weights
                    best = able[np.argmax(space @ (item * weights) / np.sqrt((space * space).sum(axis=1)))]
                space, bins, held = residual[best].copy(), many[best], runs[best]
                keep = np.arange(len(many)) != best
            else:
                space, bins, held, keep = full, left, [], np.ones(len(many), bool)
            times = min(fits(space, item), left)
            used = min(bins, left // times)
            fresh = [(space - times * item, used, [*held, (length, times)])]
            if len(able) and used < bins:
                fresh.append((space, bins - used, held))
            left -= used * times
            residual = np.concatenate([residual[keep], [f[0] for f in fresh]])
            many = [m for m, k in zip(many, keep) if k] + [f[1] for f in fresh]
            runs = [r for r, k in zip(runs, keep) if k] + [f[2] for f in fresh]
        # a group whose rest is smaller than any further piece is closed
        lower = min((x for x in counts if x < length), default=None)
        if lower is not None:
            open_ = (residual >= np.array([lower, 1, lower * lower])).all(axis=1)
            done += [(m, r) for m, r, o in zip(many, runs, open_) if not o]
            residual = residual[open_]
            many = [m for m, o in zip(many, open_) if o]
            runs = [r for r, o in zip(runs, open_) if o]
    slots, given, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, held in done + list(zip(many, runs)):
        offset = 0
        for length, times in held:
            slots.append((length, given[length], sequence, times, offset))
            given[length] += bins * times
            offset += length * times
        sequence += bins
    return np.array(sorted(slots), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacities: Capacities = Capacities(), vocabulary: Vocabulary = Vocabulary(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All texts packed: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Only texts longer than a sequence are cut. Every input row is packed, repeated
    rows and rows with a null id too; an empty table gives no rows. Ties between
    equally good bins go to the older group. What reaches the driver is one count
    per distinct length, at most ``capacities.tokens`` rows.
    """
    cut_pieces = cut(pieces(docs, capacities.tokens, vocabulary, id_col, text_col))
    sizes = cut_pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))))
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    slots = best_fit(counts, capacities)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (slots[:, 0] << 44) + slots[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            row = slots[np.searchsorted(keys, (length << 44) + rank, side="right") - 1]
            within = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(5)]
                + [pa.array(row[:, 2] + within // row[:, 3]), pa.array(row[:, 4] + (within % row[:, 3]) * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = cut_pieces.join(sizes, ["length", "_task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_seen")).alias("_rank")
    )
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(place, fields)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
