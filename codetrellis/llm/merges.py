"""Merge-rank encoding and decoding with a tokenizer file.

A text is cut at the file's added tokens, then at white space; every distinct chunk
of a task is normalised and cut into pre-tokens as the file declares, and its symbols
are merged once. Merging keeps the symbols in a doubly linked list and the possible
merges in a priority queue by rank and place; an entry whose symbols have changed
since it was queued is stale and skipped. Decoding joins the vocabulary's strings.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from types import ModuleType

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrellis.llm.blocks import blocks, text_bytes
from codetrellis.llm.registry import query, table

#: fixed values: control characters that Python's ``str.split`` takes for white space and ``\s`` does not
NOT_SPACE = re.compile("[\x1c-\x1f]")
#: fixed values: the white space of ``\s``
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: fixed values: the rules of the tokenizer file that are read
RULES = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split",
                "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                "behavior": "Removed",
                "invert": True,
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: fixed value: characters below it have had one class, one lower case and one normal form, their own, since
#: Unicode 5, so every library agrees on them; other characters are left to the one that reads the file
SETTLED = "\u0250"


@dataclass(frozen=True)
class Merging:
    """A tokenizer file and how much of its work a task remembers.

    ``chunk`` and ``remembered`` bound memory only: chunks of more characters are merged each time they
    occur, and at half of so many bytes what was remembered becomes the older half, whose strings
    stay only if they come again.
    """

    tokenizer: str = public_tokenizers.path("word_bpe_49k.json")
    chunk: int = 64
    remembered: int = 100_000_000
    block_bytes: int = 4 << 20


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


#: what a remembered string and its ids take beside the string itself, measured
ENTRY_BYTES = 115


class Merger:
    """The merge table of a file and its use on one pre-token."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain merge models are read")
        if model.get("continuing_subword_prefix"):
            raise ValueError("a prefix of continuing symbols is not read")
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.inner = [ids[c] for c in byte_names()]
        self.last = [ids[c + suffix] for c in byte_names()]
        self.ranks: dict[int, int] = {}  # of pairs of ids
        self.made: list[int] = []  # by rank
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            self.ranks[ids[a] << 32 | ids[b]] = rank
            self.made.append(ids[a + b])

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        symbol = [*map(self.inner.__getitem__, piece)]
        symbol[-1] = self.last[piece[-1]]
        n, rank_of, made = len(symbol), self.ranks.get, self.made
        if n == 1:
            return symbol
        # an entry is a rank and a place, so the queue gives the lowest rank first and of equal ones the first place
        queue, left = [], symbol[0]
        for i, right in enumerate(symbol[1:]):
            rank = rank_of(left << 32 | right)
            if rank is not None:
                queue.append(rank << 32 | i)
            left = right
        if not queue:
            return symbol
        heapify(queue)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            a, j = symbol[i], after[i]
            if a < 0 or j >= n:
                continue  # stale: the symbol is gone, or is the last one now
            now = rank_of(a << 32 | symbol[j])
            a = made[entry >> 32]
            if now is None or made[now] != a:
                continue  # stale: one of the two has been merged since
            symbol[i] = a
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(a << 32 | symbol[k])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            k = before[i]
            if k >= 0:
                rank = rank_of(symbol[k] << 32 | a)
                if rank is not None:
                    heappush(queue, rank << 32 | k)
        return [s for s in symbol if s >= 0]


class Encoder:
    """Texts to ids; one per task."""

    def __init__(self, spec: Merging):
        import regex
        from tokenizers import Tokenizer

        with open(spec.tokenizer, encoding="utf-8") as lines:
            declared = json.load(lines)
        rules = {"normalizer": declared["normalizer"], "pre_tokenizer": declared["pre_tokenizer"]}
        if rules != RULES or declared["post_processor"] is not None:
            raise ValueError("the file has other rules than those that are read")
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in declared["added_tokens"]):
            raise ValueError("added tokens are read as they stand in a text, without more rules")
        library = Tokenizer.from_file(spec.tokenizer)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(RULES["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.byte_of = {c: b for b, c in enumerate(byte_names())}
        self.spec, self.merger = spec, Merger(declared["model"])
        self.added = {t["content"]: packed([t["id"]]) for t in declared["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}
        self.older: tuple[dict, dict] = {}, {}
        self.held = 0

    def _keep(self, kept: dict, key, found: bytes) -> bytes:
        if len(key) <= self.spec.chunk:
            kept[key] = found
            self.held += len(key) + ENTRY_BYTES
            if 2 * self.held > self.spec.remembered:
                self.older = self.chunks, self.pieces
                self.chunks, self.pieces, self.held = {}, {}, 0
        return found

    def pre_tokens(self, text: str) -> list[bytes]:
        """Pre-tokens of a stretch without white space, as bytes."""
        if max(text) < SETTLED:
            return [p.encode() for p in self.find(text.lower())]
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in self.cut(self.normalise(text))]

    def piece(self, piece: bytes) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            found = self.older[1].get(piece)
            found = self._keep(self.pieces, piece, packed(self.merger.merge(piece)) if found is None else found)
        return found

    def chunk(self, text: str) -> bytes:
        """Ids of a stretch without white space: no pre-token and no normal form reaches across it."""
        found = self.chunks.get(text)
        if found is None:
            found = self.older[0].get(text)
            if found is None:
                found = b"".join([self.piece(p) for p in self.pre_tokens(text)])
            found = self._keep(self.chunks, text, found)
        return found

    def plain(self, text: str) -> bytes:
        chunks = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        known = self.chunks.get  # the halves may move on meanwhile, which changes no answer
        return b"".join([known(c) or self.chunk(c) for c in chunks if c])

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not any(t in text for t in self.added):
            return self.plain(text)
        return b"".join([self.added[p] if p in self.added else self.plain(p) for p in self.marks.split(text)])


def worker_encoder(spec: Merging) -> Encoder:
    """The encoder of this Python worker, which keeps what it has merged from one task to the next.

    This subpackage is sent with each task, so what is to last is kept under a name of its own.
    """
    kept = sys.modules.setdefault("_kept_encoders", ModuleType("_kept_encoders")).__dict__
    if repr(spec) not in kept:
        kept[repr(spec)] = Encoder(spec)
    return kept[repr(spec)]


def encode(docs: DataFrame, spec: Merging = Merging(), text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens") -> DataFrame:
    """``docs`` without its text, and with every text's ids (binary, little-endian unsigned 32-bit) and their number.

    Null and empty texts have no ids. Rows are independent: repeated rows, null ids, ties
    and further columns change nothing, an empty table gives no rows, and a column that has
    the name of a result gives way to it. A text of any length is encoded whole; a task holds its
    ids, and of a stretch without white space some 300 bytes a character while it is merged.
    """
    kept = [c for c in docs.columns if c not in (text_col, ids_col, count_col)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string"))
    fields = [given.schema[c] for c in kept]
    names = [*kept, ids_col, count_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(spec)
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in blocks(text_bytes(texts)[1], spec.block_bytes):
                ids = [encoder.encode(t.as_py() or "") for t in texts.slice(a, b - a)]
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids, pa.binary()), counts], names)

    schema = T.StructType([*fields, T.StructField(ids_col, T.BinaryType()), T.StructField(count_col, T.LongType())])
    return given.mapInArrow(run, schema)


def decode(rows: DataFrame, spec: Merging = Merging(), ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` and the text of their ids, as the file has no decoder: the tokens' strings joined by one space.

    Special tokens are kept; ids that the file lacks are left out, null ids give an empty text. A
    column that has the name of the result gives way to it.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != text_col])
    at, size, names = rows.columns.index(ids_col), len(rows.columns), [*rows.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(spec.tokenizer, encoding="utf-8") as lines:
            declared = json.load(lines)
        if declared["decoder"] is not None:
            raise ValueError("a decoder is not read")
        strings = {i: s for s, i in declared["model"]["vocab"].items()}
        strings |= {t["id"]: t["content"] for t in declared["added_tokens"]}
        for batch in batches:
            for a, b in blocks(text_bytes(batch.column(at))[1], spec.block_bytes):
                part = [batch.column(i).slice(a, b - a) for i in range(size)]
                texts = []
                for ids in part[at]:
                    tokens = np.frombuffer(ids.as_py() or b"", "<u4").tolist()
                    try:
                        texts.append(" ".join([strings[i] for i in tokens]))
                    except KeyError:
                        texts.append(" ".join([strings[i] for i in tokens if i in strings]))
                yield pa.RecordBatch.from_arrays([*part, pa.array(texts, pa.string())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


@query("op11_bpe_round_trip")
def op11_bpe_round_trip(spark, sf_dir):
    """Every document's ids and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
