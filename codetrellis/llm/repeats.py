"""Removal of long repeated byte strings by a content-defined parse.

Each text is parsed into phrases. The trigger of a window of ``length`` bytes is
the place of its smallest rolling hash; consecutive windows of one trigger form a
phrase, so phrases overlap by ``length - 1`` bytes, every window lies in one
phrase, and equal windows have equal triggers wherever they occur. Corpus order is then
found from two parts: the parse, in which a phrase that occurs twice repeats all its
windows and one whose trigger occurs once repeats none, and the dictionary of the
remaining phrases, whose suffixes are ordered to a depth of ``length`` bytes;
neighbours of equal prefix are repeats. Only dictionary phrases travel as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.blocks import SOUND, Rolling, blocks, mixed, text_bytes
from codetrellis.llm.registry import query, table

ENTRY = np.dtype([("t", "<u8"), ("a", "<u8"), ("b", "<u8"), ("k", "u1")])
PHRASE = np.dtype([("a", "<u8"), ("b", "<u8"), ("k", "u1"), ("n", "<u4")])
WINDOW = np.dtype([("a", "<u8"), ("b", "<u8"), ("k", "u1")])
#: what a chunk is told about a phrase: all windows repeat; send its text (undecided, repeated);
#: send its windows one by one (undecided, repeated); the same for all phrases of a trigger
ALL, SEND, SEND_ALL, SPLIT, SPLIT_ALL, SPLIT_TRIGGER = 1, 2, 3, 4, 5, 6


@dataclass(frozen=True)
class Repeats:
    """``length`` of a repeated string, ``gram`` bytes hashed for a trigger.

    Texts are dealt into chunks of about ``chunk_bytes``; copies of one row are dealt by the
    partition they stand in. A trigger with more than
    ``phrases`` different phrases (``own`` of them in one chunk) is compared window by
    window, keyed by the window, so that no trigger's phrases meet in one task.
    """

    length: int = 200
    gram: int = 64
    chunk_bytes: int = 4 << 20
    phrases: int = 4096
    own: int = 16


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    rows = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    rows[: len(x)] = x
    rows = rows.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


class Parser:
    """Phrases of a block of texts."""

    def __init__(self, spec: Repeats):
        if not 0 < spec.gram <= min(spec.length, SOUND):
            raise ValueError(f"gram must be at most length and {SOUND}")
        self.spec, self.one = spec, Rolling(11)

    def phrases(self, data: np.ndarray, offsets: np.ndarray):
        """First and last window of every phrase, its trigger and two fingerprints."""
        length, gram, n = self.spec.length, self.spec.gram, len(data)
        self.sums = self.one.prefix(data)
        self.hashes = hashes = mixed(self.one.windows(self.sums, gram))
        bits = np.uint64((1 << max(n, 1).bit_length()) - 1)
        best = sliding_minimum((hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        inside = np.zeros(n + 1, np.int8)
        whole = np.diff(offsets) >= length
        inside[offsets[:-1][whole]] += 1
        inside[offsets[1:][whole] - length + 1] -= 1
        at = np.flatnonzero(np.cumsum(inside, dtype=np.int8))
        if not len(at):
            none = np.zeros(0, np.int64)
            return none, none, *[none.astype(np.uint64)] * 3
        trigger = (best[at] & bits).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (at[1:] != at[:-1] + 1)
        first = at[new]
        last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        place = trigger[new]
        shape = mixed(((last - first).astype(np.uint64) << np.uint64(32)) | (place - first).astype(np.uint64), 5)
        a = mixed(self.one.stretch(self.sums, first, last + length) + shape, 1)
        b = mixed(self._in_grams(first, last + length) + shape, 2)
        return first, last, hashes[place], a, b

    def _in_grams(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of stretches as sequences of grams, the last one flush with the end.

        Each gram is mixed in before the next, so no two long strings meet that differ in a gram.
        """
        out = (end - start).astype(np.uint64)
        live, at = np.arange(len(start)), np.array(start)
        while len(live):
            last = end[live] - self.spec.gram
            out[live] = mixed(out[live] ^ self.hashes[np.minimum(at[live], last)], 6)
            more = at[live] < last
            live = live[more]
            at[live] += self.spec.gram
        return out

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the windows at places of the block parsed last."""
        end = at + self.spec.length
        return mixed(self.one.stretch(self.sums, at, end), 3), mixed(self._in_grams(at, end), 4)


def window_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every place by its next ``length`` bytes: the suffix array to that depth.

    Prefix doubling from 8 bytes; places of equal prefix get equal ranks. Places
    closer than ``length`` to the end are ranked as if zeros followed.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(2 * length + 8, np.uint8)])
    step = 1
    while 2 * step <= min(8, length):
        step *= 2
    key = np.zeros(n + 2 * length, np.uint64)
    for j in range(step):
        key = (key << np.uint64(8)) | padded[j : j + len(key)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while step < length:
        more = min(step, length - step)
        ahead = np.concatenate([rank[more:], np.zeros(more, np.uint64)])
        rank = np.unique((rank << np.uint64(32)) | ahead, return_inverse=True)[1].astype(np.uint64)
        step += more
    return rank[:n].astype(np.int64)


def _packed(keys: list[np.ndarray], *columns) -> Iterator[tuple]:
    """(key values, slices) of rows sorted by ``keys``."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    for i, j in zip(starts, np.append(starts[1:], len(order))):
        yield [int(k[i]) for k in keys], *[c[order[i:j]] for c in columns]


def _records(rows: pa.Table, column: str, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All records packed in a binary column, and the row of each."""
    parts = [np.frombuffer(x, kind) for x in rows[column].to_pylist()]
    if not parts:
        return np.zeros(0, kind), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def _groups(*columns) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every row by equal columns, and the size of each group."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group, minlength=0)


def _blocks(rows: pa.Table, parser: Parser):
    """(first row, data, offsets, phrases) of every block of a chunk."""
    data, offsets = text_bytes(rows["text"])
    for i, j in blocks(offsets):
        part = offsets[i : j + 1] - offsets[i]
        block = data[offsets[i] : offsets[j]]
        yield i, block, part, parser.phrases(block, part)


def _entries(rows: pa.Table, spec: Repeats) -> np.ndarray:
    """Distinct phrases of a chunk; k: 0 once, 1 more often, 2 a trigger of too many phrases."""
    found = [np.stack(p[2:]) for _, _, _, p in _blocks(rows, Parser(spec))]
    t, a, b = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.uint64)
    group, sizes = _groups(t, a, b)
    _, one = np.unique(group, return_index=True)
    out = np.zeros(len(one), ENTRY)
    out["t"], out["a"], out["b"], out["k"] = t[one], a[one], b[one], sizes > 1
    trigger, many = _groups(out["t"])
    crowd = many[trigger] > spec.own
    markers = np.zeros(len(np.unique(out["t"][crowd])), ENTRY)
    markers["t"], markers["k"] = np.unique(out["t"][crowd]), 2
    return np.concatenate([out[~crowd], markers])


def _verdicts(rows: pa.Table, spec: Repeats) -> pa.Table:
    """What every chunk is told about its phrases of one bucket of triggers."""
    entries, row = _records(rows, "entries", ENTRY)
    chunk = rows["chunk"].to_numpy()[row]
    marker = entries["k"] == 2
    crowded = np.unique(entries["t"][marker])
    real, where = entries[~marker], chunk[~marker]
    phrase, seen = _groups(real["t"], real["a"], real["b"])
    again = np.zeros(len(seen), bool)
    np.logical_or.at(again, phrase, real["k"] == 1)
    again |= seen > 1
    _, donor = np.unique(phrase, return_index=True)
    is_donor = np.zeros(len(real), bool)
    is_donor[donor] = True
    trigger, _ = _groups(real["t"])
    different = np.bincount(trigger[donor], minlength=int(trigger.max(initial=-1)) + 1)[trigger]
    hot = (different > spec.phrases) | np.isin(real["t"], crowded)
    repeated = again[phrase]
    code = np.zeros(len(real), np.uint8)
    code[repeated] = ALL
    shared = (different > 1) & ~hot
    code[shared & ~repeated], code[shared & repeated & is_donor] = SEND, SEND_ALL
    code[hot & ~repeated], code[hot & repeated & is_donor] = SPLIT, SPLIT_ALL
    told = np.zeros(int((code > 0).sum()) + int(marker.sum()), WINDOW)
    n = int((code > 0).sum())
    told["a"][:n], told["b"][:n], told["k"][:n] = real["a"][code > 0], real["b"][code > 0], code[code > 0]
    told["a"][n:], told["k"][n:] = entries["t"][marker], SPLIT_TRIGGER
    to = np.concatenate([where[code > 0], chunk[marker]])
    out = [(k[0], t.tobytes()) for k, t in _packed([to], told)]
    return pa.table({"chunk": pa.array([o[0] for o in out], pa.int64()), "told": pa.array([o[1] for o in out], pa.binary())})


class Told:
    """Codes of a chunk's phrases."""

    def __init__(self, rows: pa.Table):
        told, _ = _records(rows, "told", WINDOW)
        self.triggers = np.unique(told["a"][told["k"] == SPLIT_TRIGGER])
        told = told[told["k"] != SPLIT_TRIGGER]
        self.told = told[np.argsort(told["a"], kind="stable")]

    def codes(self, t, a, b) -> np.ndarray:
        code = np.zeros(len(a), np.uint8)
        if len(self.told):
            at = np.minimum(np.searchsorted(self.told["a"], a), len(self.told) - 1)
            hit = (self.told["a"][at] == a) & (self.told["b"][at] == b)
            code[hit] = self.told["k"][at[hit]]
        code[np.isin(t, self.triggers)] = SPLIT
        return code


def _asked(rows: pa.Table, told: pa.Table, spec: Repeats, buckets: int) -> pa.Table:
    """Undecided phrases of a chunk as text (kind 0) or windows (kind 1), packed by bucket."""
    parser, codes = Parser(spec), Told(told)
    heads, texts, triggers, names = [], [], [], []
    for _, data, _, (first, last, t, a, b) in _blocks(rows, parser):
        code = codes.codes(t, a, b)
        sent = np.flatnonzero((code == SEND) | (code == SEND_ALL))
        _, one = np.unique(np.stack([a[sent], b[sent]]), axis=1, return_index=True)
        for i in sent[one]:
            texts.append(data[first[i] : last[i] + spec.length].tobytes())
        head = np.zeros(len(one), PHRASE)
        head["a"], head["b"], head["k"] = a[sent[one]], b[sent[one]], code[sent[one]]
        head["n"] = (last - first)[sent[one]] + spec.length
        heads.append(head)
        triggers.append(t[sent[one]])
        for kind in (SPLIT, SPLIT_ALL):
            part = np.flatnonzero(code == kind)
            at = np.concatenate([np.arange(first[i], last[i] + 1) for i in part]) if len(part) else np.zeros(0, np.int64)
            w = np.zeros(len(at), WINDOW)
            w["a"], w["b"] = parser.windows(at)
            w["k"] = kind == SPLIT_ALL
            names.append(w)
    out = []
    if heads:
        head, t = np.concatenate(heads), np.concatenate(triggers)
        body = np.empty(len(texts), object)
        body[:] = texts
        _, one = np.unique(np.stack([head["a"], head["b"]]), axis=1, return_index=True)
        head, t, body = head[one], t[one], body[one]
        for key, h, x in _packed([(t % np.uint64(buckets)).astype(np.int64)], head, body):
            out.append((0, key[0], h.tobytes(), b"".join(x)))
    if names:
        w = np.concatenate(names)
        group, sizes = _groups(w["a"], w["b"])
        _, one = np.unique(group, return_index=True)
        more = np.zeros(len(sizes), bool)
        np.logical_or.at(more, group, w["k"] == 1)
        w = w[one]
        w["k"] = more | (sizes > 1)
        for key, x in _packed([(w["a"] % np.uint64(buckets)).astype(np.int64)], w):
            out.append((1, key[0], x.tobytes(), b""))
    chunk = rows["chunk"][0].as_py() if rows.num_rows else None
    columns = list(zip(*out)) or [[]] * 4
    return pa.table(
        {
            "kind": pa.array(columns[0], pa.int32()),
            "bucket": pa.array(columns[1], pa.int64()),
            "chunk": pa.array([chunk] * len(out), pa.int64()),
            "head": pa.array(columns[2], pa.binary()),
            "body": pa.array(columns[3], pa.binary()),
        }
    )


def _answers(rows: pa.Table, kind: int, spec: Repeats) -> pa.Table:
    """Which windows of the phrases (kind 0), or which windows (kind 1), repeat, per chunk."""
    head, row = _records(rows, "head", WINDOW if kind else PHRASE)
    chunk = rows["chunk"].to_numpy()[row]
    out = []
    group, sizes = _groups(head["a"], head["b"])
    if kind:
        more = np.zeros(len(sizes), bool)
        np.logical_or.at(more, group, head["k"] == 1)
        more |= sizes > 1
        hit = more[group]
        for key, w in _packed([chunk[hit]], head[hit]):
            out.append((key[0], 1, w.tobytes(), b""))
    elif len(head):
        data = np.frombuffer(b"".join(rows["body"].to_pylist()), np.uint8)
        # equal phrases come from one donor only, so every record is a phrase of its own
        rank = window_ranks(data, spec.length)
        ends = np.cumsum(head["n"].astype(np.int64))
        count = head["n"].astype(np.int64) - spec.length + 1
        owner = np.repeat(np.arange(len(head)), count)
        at = np.arange(len(owner)) + np.repeat(ends - head["n"] - (np.cumsum(count) - count), count)
        weight = np.bincount(rank[at], weights=1 + (head["k"][owner] == SEND_ALL))
        repeats = weight[rank[at]] > 1
        lower = np.cumsum(count) - count
        open_ = np.flatnonzero(head["k"] == SEND)
        bits = np.empty(len(head), object)
        for i in open_:
            bits[i] = np.packbits(repeats[lower[i] : lower[i] + count[i]]).tobytes()
        for key, h, x in _packed([chunk[open_]], head[open_], bits[open_]):
            out.append((key[0], 0, h.tobytes(), b"".join(x)))
    columns = list(zip(*out)) or [[]] * 4
    return pa.table(
        {
            "chunk": pa.array(columns[0], pa.int64()),
            "kind": pa.array(columns[1], pa.int32()),
            "head": pa.array(columns[2], pa.binary()),
            "body": pa.array(columns[3], pa.binary()),
        }
    )


def _repeated_windows(first, last, code, a, b, parser: Parser, bits: dict, names: np.ndarray) -> np.ndarray:
    """Places of a block's windows that repeat."""
    found = [np.arange(first[i], last[i] + 1) for i in np.flatnonzero(np.isin(code, (ALL, SEND_ALL, SPLIT_ALL)))]
    for i in np.flatnonzero(code == SEND):
        n = int(last[i] - first[i]) + 1
        found.append(first[i] + np.flatnonzero(np.unpackbits(np.frombuffer(bits[int(a[i]), int(b[i])], np.uint8), count=n)))
    split = np.flatnonzero(code == SPLIT)
    if len(split) and len(names):
        at = np.concatenate([np.arange(first[i], last[i] + 1) for i in split])
        x, y = parser.windows(at)
        k = np.minimum(np.searchsorted(names["a"], x), len(names) - 1)
        found.append(at[(names["a"][k] == x) & (names["b"][k] == y)])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def _cleaned(rows: pa.Table, messages: pa.Table, spec: Repeats) -> pa.Table:
    """Removed spans and kept bytes of every text of a chunk."""
    kinds = messages["kind"].to_numpy()
    told = Told(messages.filter(pa.array(kinds == -1)).rename_columns(["_m", "kind", "told", "body"]))
    bits, names = {}, []
    for kind, head, body in zip(kinds, messages["head"].to_pylist(), messages["body"].to_pylist()):
        if kind == 1:
            names.append(np.frombuffer(head, WINDOW))
        elif kind == 0:
            at = 0
            for h in np.frombuffer(head, PHRASE):
                size = (int(h["n"]) - spec.length + 8) // 8
                bits[int(h["a"]), int(h["b"])] = body[at : at + size]
                at += size
    names = np.concatenate(names) if names else np.zeros(0, WINDOW)
    names = names[np.argsort(names["a"], kind="stable")]
    parser = Parser(spec)
    starts, ends, owner, sizes, kept = [], [], [], [], []
    for row, data, offsets, (first, last, t, a, b) in _blocks(rows, parser):
        at = _repeated_windows(first, last, told.codes(t, a, b), a, b, parser, bits, names)
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + spec.length, -1)
        gone = np.cumsum(change)[:-1] > 0
        before = np.concatenate([[False], gone[:-1]])
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.concatenate([gone[1:], [False]])
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        s, e = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        doc = np.searchsorted(offsets, s, side="right") - 1
        starts.append(s - offsets[doc])
        ends.append(e - offsets[doc])
        owner.append(doc + row)
        sizes.append(np.diff(offsets))
        for i in range(len(offsets) - 1):
            kept.append(data[offsets[i] : offsets[i + 1]][~gone[offsets[i] : offsets[i + 1]]].tobytes())
    n = rows.num_rows
    starts, ends, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, ends, owner))
    bounds = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return pa.table(
        {
            "doc_id": rows["doc_id"],
            "n_bytes": pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)),
            "spans": pa.ListArray.from_arrays(pa.array(bounds), spans),
            "kept": pa.array(kept, pa.binary()),
        }
    )


def remove_repeats(docs: DataFrame, spec: Repeats = Repeats()) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every row.

    ``spans`` are the maximal runs [start, end) of bytes covered by a string of
    ``length`` bytes that starts anywhere else too, in the same text or another; ``kept``
    are the other bytes. Strings are judged on the input. Null texts are empty;
    shorter texts are kept whole; repeated rows are copies of each other, so a text
    that is long enough goes; rows with a null doc_id are treated alike. An empty
    table gives no rows. Other columns are not read. A text is parsed in one piece,
    at some 60 bytes of memory for each of its bytes.
    """
    Parser(spec)  # figures that do not fit fail here and not in a task
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(8, size // spec.chunk_bytes)
    # copies of a row that holds much of the table go to as many chunks as it has partitions
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)))

    def entries(key: tuple, rows: pa.Table) -> pa.Table:
        found = _entries(rows, spec)
        out = [(k[0], x.tobytes()) for k, x in _packed([(found["t"] % np.uint64(chunks)).astype(np.int64)], found)]
        return pa.table(
            {
                "bucket": pa.array([o[0] for o in out], pa.int64()),
                "chunk": pa.array([key[0].as_py()] * len(out), pa.int64()),
                "entries": pa.array([o[1] for o in out], pa.binary()),
            }
        )

    def verdicts(key: tuple, rows: pa.Table) -> pa.Table:
        return _verdicts(rows, spec)

    def asked(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        return _asked(rows, told, spec, chunks)

    def answers(key: tuple, rows: pa.Table) -> pa.Table:
        return _answers(rows, key[0].as_py(), spec)

    def cleaned(key: tuple, rows: pa.Table, messages: pa.Table) -> pa.Table:
        return _cleaned(rows, messages, spec)

    by_chunk = dealt.groupBy("chunk")
    told = by_chunk.applyInArrow(entries, "bucket long, chunk long, entries binary")
    told = told.groupBy("bucket").applyInArrow(verdicts, "chunk long, told binary")
    sent = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(
        asked, "kind int, bucket long, chunk long, head binary, body binary"
    )
    replies = sent.groupBy("kind", "bucket").applyInArrow(answers, "chunk long, kind int, head binary, body binary")
    first = told.select("chunk", F.lit(-1).alias("kind"), F.col("told").alias("head"), F.lit(b"").alias("body"))
    messages = first.unionByName(replies)
    return by_chunk.cogroup(messages.groupBy("chunk")).applyInArrow(
        cleaned, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


@query(
    "op3_repeated_strings",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
n AS (SELECT r, doc_id, t, octet_length(t) AS n FROM d),
p AS (SELECT r, unnest(range(0, n - 199)) AS p FROM n WHERE n >= 200),
w AS (SELECT r, p, md5(t[p + 1:p + 200]) AS h FROM p JOIN n USING (r)),
x AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS run FROM (
  SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM x)),
s AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY r, run),
k AS (SELECT r, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone FROM s GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(len(starts), 0)::BIGINT AS n_spans,
  sha256(CASE WHEN starts IS NULL THEN t ELSE unhex(
    list_reduce(list_transform(range(0, len(starts) + 1),
      lambda i: hex(t[(CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1:(CASE WHEN i = len(starts) THEN n ELSE starts[i + 1] END)])),
      lambda x, y: x || y)) END) AS kept_sha256
FROM n LEFT JOIN k USING (r)""",
)
def op3_repeated_strings(spark, sf_dir):
    """Repeated strings of 200 bytes taken out of every document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
