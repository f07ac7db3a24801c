"""Maximal runs of repeated words, found by minimizers at several scales.

A run has a smallest period q and at least four of them. For periods in (L/2, L] the
hashes of all stretches of L words are taken and the minima of windows of L/2 of them are
kept. Inside a run two equal stretches of at least q words are a multiple of q apart,
and a window that fits in the run has its minimum again q words further on; so two
consecutive kept places of one hash, q apart, lie in every run. Such pairs are chained
and extended word by word. Periods too short for that are found by comparing the words
with themselves at each lag.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codetrellis.llm.blocks import blocks, mixed, text_bytes
from codetrellis.llm.registry import query, table

RUNS = T.ArrayType(
    T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), containsNull=False
)
_ARROW_RUNS = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")]))
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Periodic:
    """A run has ``least`` words and ``exponent`` periods (four, the scales rely on it) at least.

    Lags up to ``direct``, a power of two, are scanned one by one.
    """

    least: int = 6
    direct: int = 8
    block_bytes: int = 1 << 20

    @property
    def exponent(self) -> int:
        return 4


def _extreme(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of every window of ``width``, a power of two."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that are the minimum, or one of equal minima, of a window of ``width`` hashes."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low = np.zeros(len(hashes) + width - 1, np.uint64)  # zero never is a maximum, but of itself
    low[width - 1 : len(hashes)] = _extreme(hashes, width, np.minimum)
    return np.flatnonzero(_extreme(low, width, np.maximum) == hashes)


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def _reach(x: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int, width: int = 64) -> np.ndarray:
    """How many words from ``at`` on, by ``step`` 1 or -1, equal those ``lag`` further on."""
    total, live = np.zeros(len(at), np.int64), np.arange(len(at))
    ahead = np.arange(width) * step
    while len(live):
        here = (at[live] + step * total[live])[:, None] + ahead
        there = here + lag[live][:, None]
        inside = (here >= 0) & (there < len(x))
        same = inside & (x[np.clip(here, 0, len(x) - 1)] == x[np.clip(there, 0, len(x) - 1)])
        n = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        total[live] += n
        live = live[n == width]
    return total


def _scale(x: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Stretches (start, end, lag) that repeat themselves at a lag in (length / 2, length]."""
    place = minimizers(hashes, length // 2)
    place = place[np.lexsort((place, hashes[place]))]
    lag = np.diff(place)
    pair = (hashes[place[1:]] == hashes[place[:-1]]) & (lag > length // 2) & (lag <= length)
    first, lag = place[:-1][pair], lag[pair]
    if not len(first):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    # pairs of one lag whose stretches touch are one stretch
    head = np.ones(len(first), bool)
    head[1:] = (lag[1:] != lag[:-1]) | (first[1:] - first[:-1] > length)
    heads = np.flatnonzero(head)
    start, end, lag = first[heads], first[np.append(heads[1:], len(first)) - 1] + length, lag[heads]
    end = end + _reach(x, end, lag, 1)
    start = start - _reach(x, start - 1, lag, -1)
    return np.unique(np.stack([start, end + lag, lag], axis=1), axis=0)


def find_runs(x: np.ndarray, longest: int, spec: Periodic) -> np.ndarray:
    """Rows (start, end, period) of all runs in ``x``, by start and period.

    ``longest`` is the greatest length a run can have. What separates texts in ``x`` must
    occur once, so that no run reaches across it.
    """
    found = [np.zeros((0, 3), np.int64)]
    most = longest // spec.exponent
    for lag in range(1, min(spec.direct, most) + 1):
        start, end = _stretches(x[lag:] == x[:-lag])
        long_ = end - start + lag >= max(spec.least, spec.exponent * lag)
        found.append(np.stack([start[long_], end[long_] + lag, np.full(int(long_.sum()), lag)], axis=1))
    hashes, length = mixed(x.view(np.uint64), 41), 1
    while length < most and len(hashes) > length:
        hashes = mixed(hashes[:-length] * np.uint64(0xD1342543DE82EF95) + hashes[length:], 43)
        length *= 2
        if length > spec.direct:
            some = _scale(x, hashes, length)
            some = some[some[:, 1] - some[:, 0] >= np.maximum(spec.least, spec.exponent * some[:, 2])]
            for start, end, lag in some.tolist():
                # equal hashes were taken for equal words: look at the words themselves
                if (x[start : end - lag] == x[start + lag : end]).all():
                    found.append(np.array([[start, end, lag]]))
                else:
                    a, b = _stretches(x[lag:] == x[:-lag])
                    sure = b - a + lag >= max(spec.least, spec.exponent * lag)
                    found.append(np.stack([a[sure], b[sure] + lag, np.full(int(sure.sum()), lag)], axis=1))
    runs = np.unique(np.concatenate(found), axis=0)
    # of the periods of one stretch the smallest counts; the others are its multiples
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _block(texts: list[bytes], spec: Periodic) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Runs (start, length, period) of all texts, their bounds per text, and the collapsed texts."""
    words = [t.split() for t in texts]  # bytes are split at space and 0x09-0x0D
    sizes = np.array([len(w) for w in words], np.int64)
    flat = [w for part in words for w in part]
    names = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    # one name of its own behind every text
    ends = np.cumsum(sizes + 1) - 1
    x = np.empty(len(flat) + len(texts), np.int64)
    own = np.ones(len(x), bool)
    own[ends] = False
    x[own], x[ends] = names, -1 - np.arange(len(texts))
    runs = find_runs(x, int(sizes.max(initial=0)), spec)
    change = np.zeros(len(x) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    kept = np.cumsum(change)[:-1] == 0
    begins = ends - sizes
    owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    runs = np.stack([runs[:, 0] - begins[owner], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    collapsed = []
    for i, part in enumerate(words):
        if bounds[i] < bounds[i + 1]:
            part = [w for w, keep in zip(part, kept[begins[i] : ends[i]].tolist()) if keep]
        collapsed.append(b" ".join(part).decode())
    return runs, bounds, collapsed


def collapse_runs(docs: DataFrame, spec: Periodic = Periodic(), text_col: str = "text", runs_col: str = "runs", out_col: str = "collapsed") -> DataFrame:
    """``docs`` without its text, and with the runs of each text and the text without repetitions.

    ``runs`` is array<struct<start, length, period>> in words (stretches of characters other than
    space and 0x09-0x0D), numbered from 0, by start, then period: every maximal stretch of smallest
    period q, four periods and ``least`` words at least. ``collapsed`` are the words that no run holds
    after its first period, joined by one space. Null and empty texts have no run and collapse
    to an empty text. Rows are independent: repeated rows, null ids and further columns change
    nothing, an empty table gives no rows, a column that has the name of a result gives way to it.
    A text of any length is read whole, with some 100 bytes of memory a word.
    """
    kept = [c for c in docs.columns if c not in (text_col, runs_col, out_col)]
    given = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string"))
    names = [*kept, runs_col, out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(kept)))
            for a, b in blocks(offsets, spec.block_bytes):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
                runs, bounds, collapsed = _block(texts, spec)
                rows = pa.StructArray.from_arrays(
                    [pa.array(runs[:, i]) for i in range(3)], fields=list(_ARROW_RUNS.value_type)
                )
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), rows).cast(_ARROW_RUNS)
                yield pa.RecordBatch.from_arrays([*own, lists, pa.array(collapsed, pa.string())], names)

    fields = [given.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(runs_col, RUNS), T.StructField(out_col, T.StringType())])
    return given.mapInArrow(run, schema)


def looped(doc_id: Column, text: Column) -> Column:
    """``text`` with its words from place a on repeated at a period p, for one document in ten.

    The crc32 of the decimal ``doc_id`` says which and how; a null id changes nothing.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def changed(given: Column) -> Column:
        n = F.size(given).cast("long")
        g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        from_ = F.transform(place, lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p)))
        return F.array_join(F.transform(from_, lambda i: F.get(given, i.cast("int"))), " ")

    hit = (F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0) & text.rlike(_WORD)
    # a let-binding: the words are taken once
    return F.when(hit, F.get(F.transform(F.array(words), changed), F.lit(0))).otherwise(text)


def run_columns(runs: Column) -> dict[str, Column]:
    """Number of runs, the longest one and a digest of all."""
    ordered = F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    best = F.get(ordered, F.lit(0))
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return {
        "n_runs": F.size(runs).cast("long"),
        "start": best["s"],
        "length": -best["n"],
        "period": best["p"],
        "exponent_milli": F.floor(F.lit(-1000) * best["n"] / best["p"]),
        "runs_sha256": F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, F.lit("\n")).otherwise(F.lit(""))), 256),
    }


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    """Runs of every document, one in ten of them looped, as figures and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse_runs(docs)
    columns = run_columns(F.col("runs"))
    return found.select(
        "doc_id", *[c.alias(n) for n, c in columns.items()], F.sha2("collapsed", 256).alias("collapsed_sha256")
    )
