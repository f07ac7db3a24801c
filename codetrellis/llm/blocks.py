"""Texts as byte arrays inside a task: rolling hashes, words and shingle sets.

Everything works on a block of texts at once, in numpy. Words are hashed lane by
lane with a mixing step in between. The hash of any short stretch comes from two prefix
sums of a polynomial modulo 2^64; long stretches are hashed as sequences of short ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
#: bytes up to which a polynomial modulo 2^64 tells strings apart by itself
SOUND = 128


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an Arrow column, and the offset of each text; null is empty.

    Called once for each batch, so it is also where a task gives back what earlier batches took.
    """
    pa.default_memory_pool().release_unused()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column, pa.scalar("", column.type) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.scalar(b"", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, size = (np.int64, 8) if wide else (np.int32, 4)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * size).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text is alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b
        a = b


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of arbitrary stretches of one byte array, modulo 2^64.

    For stretches of up to ``SOUND`` bytes, or beside a hash of another kind: of 512 bytes and
    more there are strings of two letters that meet under every odd base.
    """

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.values = draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + draw.integers(0, 2, 256, np.uint64)
        self.base = int(draw.integers(0, 1 << 62, dtype=np.uint64)) * 4 + 5  # odd, of full period
        self.base &= (1 << 64) - 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            for name, base in (("_up", self.base), ("_down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self._up[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self._down[start]

    def windows(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` bytes at every place."""
        n = len(sums) - length
        return (sums[length:] - sums[:n]) * self._down[:n] if n > 0 else np.zeros(0, np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0, lanes: int = 16) -> np.ndarray:
    """64-bit hashes of stretches of bytes, eight bytes at a time with a full mixing step after each.

    Stretches of more than ``lanes`` times eight bytes are hashed one by one by a cryptographic hash.
    """
    size = ends - starts
    out = mixed(size.astype(np.uint64), 61 + salt)
    if not len(size):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero((size > 0) & (size <= 8 * lanes))
    for lane in range(lanes):
        at, left = starts[live] + 8 * lane, np.minimum(size[live] - 8 * lane, 8)
        value = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64))
        out[live] = mixed(mixed(out[live], 71 + salt) ^ value, 67 + salt)
        live = live[size[live] > 8 * (lane + 1)]
        if not len(live):
            break
    key = salt.to_bytes(4, "little")
    for i in np.flatnonzero(size > 8 * lanes):
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, key=key).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; bytes of other characters are never in that range."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes other than space and 0x09-0x0D."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of ``width`` lower-cased words: values, and bounds per text.

    A text with fewer words is one shingle; a text without words has none. Two independent
    hashes of every word go into a shingle's value.
    """
    n = len(offsets) - 1
    data = lowered(data)
    starts, ends, doc = words(data, offsets)
    hashes = word_hashes(data, starts, ends) + mixed(word_hashes(data, starts, ends, 1), 3)
    factors = mixed(np.arange(width, dtype=np.uint64), 7) | np.uint64(1)
    count = len(hashes) - width + 1
    found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if count > 0:
        total = np.full(count, width, np.uint64)
        for j in range(width):
            total += hashes[j : j + count] * factors[j]
        whole = doc[:count] == doc[width - 1 :]
        found.append(mixed(total[whole]))
        owner.append(doc[:count][whole])
    sizes = np.bincount(doc, minlength=n) if len(doc) else np.zeros(n, np.int64)
    for few in range(1, width):  # texts of exactly this many words
        at = np.searchsorted(doc, np.flatnonzero(sizes == few))
        if len(at):
            total = np.full(len(at), few, np.uint64)
            for j in range(few):
                total += hashes[at + j] * factors[j]
            found.append(mixed(total))
            owner.append(doc[at])
    values, doc = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    if len(values):
        first = np.ones(len(values), bool)
        first[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
        values, doc = values[first], doc[first]
    return values, np.searchsorted(doc, np.arange(n + 1))


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum (mod 2^64) of ``values`` in every [bounds[i], bounds[i + 1])."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]
