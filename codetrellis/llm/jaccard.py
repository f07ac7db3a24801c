"""Exact Jaccard join of shingle sets by a partition of the universe.

Two sets of similarity t differ in at most H shingles, H being bounded by their
sizes. Shingles are hashed into segments; if there are enough segments, two such
sets agree in some segment, or there differ by one shingle. Sets are taken by size band;
each band has its own number of segments, chosen by cost. What a segment holds of
a set is indexed under one signature, segments with a one-deletion neighbourhood
also under one signature per left-out shingle. Sets that share a signature are
candidates and are verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from codetrellis.llm.blocks import blocks, mixed, shingle_sets, sums_by, text_bytes
from codetrellis.llm.links import connected
from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut, cut as cut_to_files, top_k


@dataclass(frozen=True)
class Join:
    """Similarity ``num / den`` on shingles of ``width`` words.

    ``expected`` sets in a band (a tenth of all if not given) and the chance ``common`` that a
    shingle of one set is in an unrelated one steer the cost only, never the result.
    """

    width: int = 5
    num: int = 80
    den: int = 100
    ratio: float = 1.25
    expected: int | None = None
    common: float = 0.01
    #: share of the differing segments that a set may drop as frequent
    frequent: float = 0.1
    #: members of a signature up to which every pair is looked at; larger signatures are dropped by the
    #: sets that can spare them
    few: int = 8
    #: shingles of one candidate group that are verified together in one task
    together: int = 4_000_000
    #: share of segments with one-deletion neighbourhoods; None lets the cost decide
    deletions: float | None = None
    #: members above which a table is joined by shuffle instead of being broadcast
    broadcast_rows: int = 500_000


@dataclass(frozen=True)
class Scheme:
    """``segments`` of which the first ``loose`` allow one deletion; ``spare`` may be skipped."""

    segments: int
    loose: int
    spare: int


def band_edges(ratio: float, upto: int) -> np.ndarray:
    """Smallest size of every band, as far as ``upto``."""
    edges = [1]
    while edges[-1] <= upto:
        edges.append(int(edges[-1] * ratio) + 1)
    return np.array(edges, np.int64)


def _scheme(join: Join, low: int, high: int) -> Scheme:
    """Segments for sets of sizes ``low`` to ``high`` and the smaller ones they can join.

    Each segment that differs uses up one of the H differing shingles, a loose one two;
    segments and loose ones together must exceed H by the spare ones, so that an agreeing
    segment is left when up to ``spare`` empty and frequent segments are left out.
    """
    differing = 2 * high * (join.den - join.num) // (join.den + join.num)
    size = (low + high) / 2
    best = None
    shares = (0.0, 0.25, 0.5, 1.0) if join.deletions is None else (join.deletions,)
    for share in shares:
        for spare in range(0, 2 * differing + 8):
            segments = math.ceil((differing + 1 + spare) / (1 + share))
            loose = max(differing + 1 + spare - segments, 0)
            strict, per = segments - loose, size / segments
            # a segment holds j shingles of a set with a Poisson chance; an unrelated set has the
            # same if it has these j, each by chance, and no other
            empty, single = math.exp(-per), per * math.exp(-per)
            enough = strict * empty + 2 * math.sqrt(strict * empty) + join.frequent * differing <= spare
            if not enough and spare < 2 * differing + 7:
                continue
            more = sum(math.exp(-per + j * math.log(per * join.common) - math.lgamma(j + 1)) for j in range(2, 12))
            chance = more + single * join.common + (0 if enough else empty)
            # one of a pair may lack a shingle of the other: an empty segment meets single ones
            near = empty + 2 * single + 3 * (1 + per) * (single * join.common + more)
            cost = segments + loose * per + join.expected * empty * (strict * chance + loose * near)
            if best is None or cost < best[0]:
                best = (cost, Scheme(segments, loose, spare))
            break
    return best[1]


class Indexer:
    """Signatures of sets; one per task."""

    def __init__(self, join: Join):
        self.join = join
        self.scheme = lru_cache(None)(lambda band, low, high: _scheme(join, low, high))
        self.edges = band_edges(join.ratio, 64)

    def band(self, sizes):
        if len(sizes) and sizes.max() >= self.edges[-1]:
            self.edges = band_edges(self.join.ratio, int(sizes.max()))
        return np.searchsorted(self.edges, sizes, side="right") - 1

    def signatures(self, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """Signature, set number, whether a shingle was left out, how many more the set could do
        without, and the band."""
        sizes = np.diff(bounds)
        reach = sizes * self.join.den // self.join.num
        top = self.band(reach)
        first = self.band(sizes)
        out = [[], [], [], [], []]
        for band in range(int(first.min(initial=0)), int(top.max(initial=-1)) + 1):
            sets = np.flatnonzero((first <= band) & (band <= top) & (sizes > 0))
            if len(sets):
                for kept, part in zip(out, self._under(band, sets, values, bounds)):
                    kept.append(part)
        if not out[0]:
            return tuple(np.zeros(0, k) for k in (np.uint64, np.int64, bool, np.int64, np.int64))
        return tuple(np.concatenate(x) for x in out)

    def _under(self, band: int, sets, values, bounds):
        scheme = self.scheme(band, int(self.edges[band]), int(self.edges[band + 1]) - 1 if band + 1 < len(self.edges) else int(self.edges[band]))
        sizes = bounds[sets + 1] - bounds[sets]
        row = np.repeat(np.arange(len(sets)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(bounds[sets], sizes)
        tokens = values[at]
        segment = (mixed(tokens, 11) % np.uint64(scheme.segments)).astype(np.int64)
        weight = mixed(tokens, 13)
        cell = row * scheme.segments + segment
        total = np.zeros(len(sets) * scheme.segments, np.uint64)
        np.add.at(total, cell, weight)
        held = np.bincount(cell, minlength=len(total)).reshape(len(sets), -1)
        strict = np.arange(scheme.segments) >= scheme.loose
        # empty segments are skipped if the spare ones allow it; what is skipped must be nested
        # between any two sets, so only a set that skips them may drop frequent signatures too
        skip = (held == 0) & strict
        allowed = skip.sum(axis=1) <= scheme.spare
        skip[~allowed] = False
        spared = np.where(allowed, scheme.spare - skip.sum(axis=1), 0)
        own = np.flatnonzero(~skip.ravel())
        name = mixed(np.arange(scheme.segments, dtype=np.uint64), 17 + band)
        signature = [mixed(total[own] ^ name[own % scheme.segments])]
        owner, less = [own // scheme.segments], [np.zeros(len(own), bool)]
        if scheme.loose:
            near = np.flatnonzero(segment < scheme.loose)
            signature.append(mixed((total[cell[near]] - weight[near]) ^ name[segment[near]]))
            owner.append(row[near])
            less.append(np.ones(len(near), bool))
        owner = np.concatenate(owner)
        # a loose segment weighs two, so only sets whose spare ones cover strict segments count
        room = spared[owner] // (2 if scheme.loose else 1)
        return np.concatenate(signature), sets[owner], np.concatenate(less), room, np.full(len(owner), band)


def fingerprints(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart: equal sets have equal ones."""
    return mixed(sums_by(mixed(values, 23), bounds), 1), mixed(sums_by(mixed(values, 29), bounds), 2)


def _sets(batch_column, join: Join):
    """(first, last, values, bounds) of every block of a batch of texts."""
    data, offsets = text_bytes(batch_column)
    for a, b in blocks(offsets):
        part = offsets[a : b + 1]
        yield (a, b, *shingle_sets(data[part[0] : part[-1]], part - part[0], join.width))


def sketches(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bits of every set, as 64-bit words, and the bounds of each set's words.

    At least 1024 and, beyond 512 shingles, at least two bits a shingle; the number is a power of
    two, so that the longer of two sketches folds to the shorter. Sets differ in at
    least as many shingles as bits.
    """
    sizes = np.diff(bounds)
    bits = 1 << np.maximum(10, np.ceil(np.log2(np.maximum(2 * sizes, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(bits)])
    row = np.repeat(np.arange(len(sizes)), sizes)
    out = np.zeros(int(ends[-1]), np.uint8)
    at = mixed(values, 31) % bits[row].astype(np.uint64)
    np.bitwise_xor.at(out, ends[row] + at.astype(np.int64), 1)
    return np.packbits(out).view(np.int64), ends // 64


def set_rows(docs: DataFrame, join: Join) -> DataFrame:
    """``doc_id, f1, f2, n_shingles, sketch`` of every row; f1 and f2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(1), join):
                f1, f2 = fingerprints(values, bounds)
                words, ends = sketches(values, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(f1.view(np.int64)),
                        pa.array(f2.view(np.int64)),
                        pa.array(np.diff(bounds)),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words)),
                    ],
                    ["doc_id", "f1", "f2", "n_shingles", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, f1 long, f2 long, n_shingles long, sketch array<long>"
    )


ENTRY = np.dtype([("s", "<u4"), ("f", "<i8"), ("r", "u1"), ("b", "u1"), ("h", "u1")])
HOT = np.dtype([("v", "<i8"), ("f", "<i8"), ("r", "u1"), ("b", "u1")])


def _split_hot(entry: np.ndarray, bucket: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries and buckets without the members of signatures that more than ``few`` sets have here, and those members.

    One member of each such signature stays, marked, so that others under it learn that it is frequent.
    """
    order = np.lexsort((entry["r"] >= 128, entry["f"], entry["s"], bucket))
    entry, bucket = entry[order], bucket[order]
    new = np.ones(len(entry), bool)
    new[1:] = (entry["s"][1:] != entry["s"][:-1]) | (bucket[1:] != bucket[:-1])
    group = np.cumsum(new) - 1
    fresh = new.copy()
    fresh[1:] |= entry["f"][1:] != entry["f"][:-1]
    members = np.bincount(group, fresh)
    whole = np.bincount(group, entry["r"] < 128) > 0
    many = ((members > few) & whole)[group]
    hot = np.empty(int((many & fresh).sum()), HOT)
    held = entry[many & fresh]
    hot["v"] = (bucket[many & fresh] << 32) | held["s"].astype(np.int64)
    hot["f"], hot["r"], hot["b"] = held["f"], held["r"], held["b"]
    stays = ~many | new
    entry = entry.copy()
    entry["h"] = many & new
    return entry[stays], bucket[stays], hot


def candidate_rows(docs: DataFrame, join: Join, buckets: int) -> DataFrame:
    """Sets that share a signature: ``kind, u, v, band, room``.

    Each task hands on, per bucket of signatures, one row of packed (signature, set)
    entries without the copies in a block. Kind 0 is a pair ``u, v`` of first fingerprints,
    from signatures of up to ``few`` sets. Larger signatures give members only, kind 1:
    set ``u`` under signature ``v``, its band, and how many signatures it can spare there.
    Inside a bucket 32 bits name a signature; a clash can only add candidates. Members of signatures that
    are frequent within a task's own entries do not meet: a task hands on ``few`` of one at most.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexer = Indexer(join)
        for batch in batches:
            parts, where = [], []
            for _, last, values, bounds in _sets(batch.column(0), join):
                f1, _ = fingerprints(values, bounds)
                _, one = np.unique(f1, return_index=True)  # copies inside a block are indexed once
                one = one[np.diff(bounds)[one] > 0]
                if len(one):
                    sizes = np.diff(bounds)[one]
                    at = np.arange(int(sizes.sum())) + np.repeat(bounds[one] - (np.cumsum(sizes) - sizes), sizes)
                    s, owner, less, room, band = indexer.signatures(values[at], np.concatenate([[0], np.cumsum(sizes)]))
                    entry = np.empty(len(s), ENTRY)
                    entry["s"], entry["f"], entry["b"] = s >> np.uint64(32), f1[one][owner].view(np.int64), band
                    entry["r"], entry["h"] = np.minimum(room, 127) + 128 * less, 0
                    parts.append(entry)
                    where.append((s % np.uint64(buckets)).astype(np.int64))
                # handed on by some 260,000 entries, to keep little in memory
                if parts and (last == batch.num_rows or sum(map(len, parts)) > 1 << 18):
                    entry, bucket = np.concatenate(parts), np.concatenate(where)
                    parts, where = [], []
                    entry, bucket, hot = _split_hot(entry, bucket, join.few)
                    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                    rows = [entry[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(bucket)))]
                    # the members of frequent signatures go to groups of their own, below zero
                    aside = -1 - int(mixed(np.array([hot["f"][0]]).view(np.uint64), 5)[0] % np.uint64(buckets)) if len(hot) else None
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([*bucket[cuts].tolist(), *([aside] if len(hot) else [])], pa.int64()),
                            pa.array([*rows, *([hot.tobytes()] if len(hot) else [])], pa.binary()),
                        ],
                        ["bucket", "entries"],
                    )

    def found(pairs: np.ndarray, u: np.ndarray, v: np.ndarray, band: np.ndarray, room: np.ndarray) -> pa.Table:
        n, none = pairs.shape[1], np.zeros(pairs.shape[1], np.int64)
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1], [n, len(u)]).astype(np.int32)),
                "u": pa.array(np.concatenate([pairs[0], u])),
                "v": pa.array(np.concatenate([pairs[1], v])),
                "band": pa.array(np.concatenate([none, band]).astype(np.int32)),
                "room": pa.array(np.concatenate([none, room % 128]).astype(np.int32)),
            }
        )

    def meet(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            hot = np.concatenate([np.frombuffer(x, HOT) for x in rows["entries"].to_pylist()])
            return found(np.zeros((2, 0), np.int64), hot["f"], hot["v"], hot["b"], hot["r"])
        entry = np.concatenate([np.frombuffer(x, ENTRY) for x in rows["entries"].to_pylist()])
        less = entry["r"] >= 128
        entry = entry[np.lexsort((less, entry["f"], entry["s"]))]
        new = np.ones(len(entry), bool)
        new[1:] = (entry["s"][1:] != entry["s"][:-1]) | (entry["f"][1:] != entry["f"][:-1])
        marked = np.logical_or.reduceat(entry["h"] > 0, np.flatnonzero(new))
        entry = entry[new]
        first = np.flatnonzero(np.diff(entry["s"].astype(np.int64), prepend=-1))
        sizes = np.diff(np.append(first, len(entry)))
        # sets that only share a left-out form differ by two shingles there: not asked for
        whole = np.logical_or.reduceat(entry["r"] < 128, first)
        frequent = (sizes > join.few) | np.logical_or.reduceat(marked, first)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(2, join.few + 1):
            some = first[(sizes == n) & whole & ~frequent]
            members = entry["f"][some[:, None] + np.arange(n)]
            i, j = np.triu_indices(n, 1)
            us.append(members[:, i].ravel())
            vs.append(members[:, j].ravel())
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1)
        hot = entry[np.repeat(frequent & whole, sizes)]
        name = (int(key[0].as_py()) << 32) | hot["s"].astype(np.int64)
        return found(pairs, hot["f"], name, hot["b"], hot["r"])

    packed = docs.select("text").mapInArrow(index, "bucket long, entries binary")
    return packed.groupBy("bucket").applyInArrow(meet, "kind int, u long, v long, band int, room int").distinct()


def candidate_edges(found: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Edges ``u, v`` that connect, directly or not, all sets of enough similarity.

    Pairs are dropped if their parity sketches differ in too many bits. Of the large
    signatures a set drops those of a band if it can spare them all: an agreeing one is
    left by the count of segments. The others' members hang on the smallest of them.
    """
    one = classes.groupBy("f1").agg(F.first("sketch").alias("_s"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_c"))
    a = one.select(F.col("f1").alias("u"), F.col("_s").alias("_su"), F.col("_n").alias("_nu"), F.col("_c").alias("_cu"))
    b = one.select(F.col("f1").alias("v"), F.col("_s").alias("_sv"), F.col("_n").alias("_nv"), F.col("_c").alias("_cv"))
    words = F.least(F.size("_su"), F.size("_sv"))

    def folded(sketch):  # sizes of a pair differ by less than two, so one fold is enough
        halves = F.zip_with(F.slice(sketch, F.lit(1), words), F.slice(sketch, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sketch) > words, halves).otherwise(F.col(sketch))

    differing = F.zip_with(folded("_su"), folded("_sv"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(differing, F.lit(0), lambda n, x: n + x)
    smaller, larger = F.least("_nu", "_nv"), F.greatest("_nu", "_nv")
    pairs = found.filter("kind = 0").select("u", "v").join(a, "u").join(b, "v")
    # f1 may, once in a great while, name two sets: such pairs stay
    alike = pairs.filter(join.den * smaller >= join.num * larger)
    if 2 * join.num > join.den:  # else one fold would not be enough
        alike = alike.filter(
            (F.col("_cu") + F.col("_cv") > 2)
            | (apart * (join.den + join.num) <= (F.col("_nu") + F.col("_nv")) * (join.den - join.num))
        )
    alike = alike.select("u", "v")
    members = found.filter("kind = 1")
    per = members.groupBy("u", "band").agg(F.count(F.lit(1)).alias("_many"))
    left = cut(members.join(per, ["u", "band"]).filter("_many > room").select("u", "v"))
    lowest = left.groupBy("v").agg(F.min("u").alias("_low"))
    stars = left.join(lowest, "v").filter("u <> _low").select(F.col("_low").alias("u"), F.col("u").alias("v"))
    return alike.unionByName(stars)


def verified_groups(values: list[np.ndarray], join: Join) -> np.ndarray:
    """Group number of every set: sets of similarity num / den are in one group.

    Only sets not yet in one group are compared.
    """
    sizes = np.array([len(v) for v in values])
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    _, codes = np.unique(np.concatenate([values[i] for i in order]), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    group = np.arange(len(order))
    mark = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
    for i in range(len(order)):
        last = int(np.searchsorted(sizes, sizes[i] * join.den // join.num, side="right"))
        if last <= i + 1 or (group[i + 1 : last] == group[i]).all():
            continue
        mark[codes[bounds[i] : bounds[i + 1]]] = 1
        common = np.add.reduceat(mark[codes[bounds[i + 1] : bounds[last]]], bounds[i + 1 : last] - bounds[i + 1])
        mark[codes[bounds[i] : bounds[i + 1]]] = 0
        union = sizes[i] + sizes[i + 1 : last] - common
        near = np.unique(group[i + 1 : last][join.den * common >= join.num * union])
        if len(near):
            group[np.isin(group, near)] = group[i]
    out = np.empty(len(order), np.int64)
    out[order] = group
    return out


def _with_sets(texts: DataFrame, join: Join, extra: str) -> DataFrame:
    """``extra, f1, f2, doc_id, shingles`` of the rows whose text has the set named f1, f2.

    A task gives each set once, so a row that repeats very often is one for each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(0), join):
                f1, f2 = fingerprints(values, bounds)
                own = [batch.column(i).slice(a, b - a) for i in range(1, 5)]
                same = (own[1].to_numpy(zero_copy_only=False) == f1.view(np.int64)) & (own[2].to_numpy(zero_copy_only=False) == f2.view(np.int64))
                for i in np.flatnonzero(same):
                    name = int(f1[i]), int(f2[i])
                    same[i] = name not in seen
                    seen.add(name)
                sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))
                out = pa.RecordBatch.from_arrays([*own, sets], [extra, "f1", "f2", "doc_id", "shingles"])
                yield out.filter(pa.array(same))

    return texts.select("text", extra, "f1", "f2", "doc_id").mapInArrow(
        run, f"{extra} long, f1 long, f2 long, doc_id long, shingles array<long>"
    )


def _small_groups(sets: DataFrame, join: Join) -> DataFrame:
    """Labels of the sets of candidate groups that fit in a task: ``f1, f2, label``."""

    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        f = np.stack([rows["f1"].to_numpy(), rows["f2"].to_numpy()])
        _, one = np.unique(f, axis=1, return_index=True)
        column = rows["shingles"].combine_chunks()
        group = verified_groups([column[int(i)].values.to_numpy() for i in one], join)
        ids = rows["doc_id"].to_numpy()[one]
        lowest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, ids)
        return pa.table({"f1": pa.array(f[0][one]), "f2": pa.array(f[1][one]), "label": pa.array(lowest[group])})

    return sets.groupBy("part").applyInArrow(verify, "f1 long, f2 long, label long")


def _large_groups(sets: DataFrame, join: Join, pivots: int = 4) -> DataFrame:
    """Labels of the sets of candidate groups too large for a task: ``f1, f2, label``.

    In rounds: of every signature shared by sets of different labels the first
    sets are compared with all others of another label, links are merged into the labels,
    and those first sets leave the signature: whatever is left undecided about
    them is decided. A group of near copies gets one label in the first round. No
    signature's members are gathered in one task: the first ones are cut before the shuffle, and dealt
    out by range where there are very many. What a round builds on is read from files, as in ``links.connected``.
    """
    sets = cut(sets.dropDuplicates(["f1", "f2"]).withColumn("node", F.monotonically_increasing_id()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexer = Indexer(join)
        for batch in batches:
            column = batch.column(1)
            bounds = column.offsets.to_numpy().astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            s, owner, *_ = indexer.signatures(values, bounds - bounds[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.view(np.int64)), batch.column(0).take(pa.array(owner))], ["signature", "node"]
            )

    live = cut(sets.select("node", "shingles").mapInArrow(index, "signature long, node long").distinct())
    labels = cut_to_files(sets.select("node", F.col("node").alias("label")))
    while True:
        known = live.join(labels, "node")
        mixed_ = known.groupBy("signature").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).filter("_a <> _b")
        known = cut_to_files(known.join(mixed_.select("signature"), "signature"))
        if known.isEmpty():
            break
        lead = top_k(known, ["signature"], ["node"], pivots, "_n")
        lead = cut_to_files(lead.select("signature", F.col("node").alias("u"), F.col("label").alias("_lu")))
        pairs = (
            known.join(lead, "signature")
            .filter("label <> _lu")
            .select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v"))
            .distinct()
        )
        a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("_su"))
        b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("_sv"))
        common = F.size(F.array_intersect("_su", "_sv"))
        links = (
            pairs.join(a, "u").join(b, "v")
            .withColumn("_c", common)
            .filter(F.lit(join.den) * F.col("_c") >= F.lit(join.num) * (F.size("_su") + F.size("_sv") - F.col("_c")))
        )
        ends = labels.select(F.col("node").alias("u"), F.col("label").alias("_lu"))
        other = labels.select(F.col("node").alias("v"), F.col("label").alias("_lv"))
        merged = connected(links.select("u", "v").join(ends, "u").join(other, "v").select(F.col("_lu").alias("u"), F.col("_lv").alias("v")))
        merged = merged.select(F.col("node").alias("label"), F.col("label").alias("_to"))
        labels = cut_to_files(labels.join(merged, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))
        pivots *= 4
        live = cut_to_files(known.select("signature", "node").join(lead.select("signature", F.col("u").alias("node")), ["signature", "node"], "left_anti"))
    named = sets.select("node", "f1", "f2", "doc_id").join(labels, "node")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("_low"))
    return named.join(lowest, "label").select("f1", "f2", F.col("_low").alias("label"))


def with_fingerprints(docs: DataFrame, join: Join, names: tuple[str, str] = ("_f1", "_f2")) -> DataFrame:
    """``docs`` and the name of the set of each row's text, as in ``near_groups``, in two columns ``names``.

    Columns that have these names give way.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, values, bounds in _sets(batch.column(at), join):
                found = [pa.array(f.view(np.int64)) for f in fingerprints(values, bounds)]
                own = [c.slice(a, b - a) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*own, *found], [*batch.schema.names, *names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, LongType()) for n in names]]))


def near_groups(docs: DataFrame, join: Join = Join(), names: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row with a ``doc_id``; with ``names`` also ``f1, f2`` of its set.

    ``component_id`` is the smallest doc_id reached by links of similarity num / den or
    more. Rows with a null doc_id are left out. Null and empty texts, and texts without words, have
    no shingles and are linked with nothing, their own id is their component; fewer
    words than a shingle make one shingle. Repeated rows give repeated rows. Copies of
    a set are one member of the join; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = cut(set_rows(docs, join))
    if join.expected is None:
        join = replace(join, expected=rows.count() // 10 + 1)
    classes = rows.filter("n_shingles > 0").groupBy("f1", "f2").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("_n"), F.first("sketch").alias("sketch")
    )
    found = cut(candidate_rows(docs, join, max(16, size >> 22)))
    edges = candidate_edges(found, classes, join)
    classes = classes.drop("sketch")
    parts = cut(connected(edges).select(F.col("node").alias("f1"), F.col("label").alias("part")))
    members = cut(classes.join(parts, "f1"))
    sizes = members.groupBy("part").agg(F.sum("_n").alias("_all"))
    members = cut(members.join(sizes, "part").select("part", "f1", "f2", "doc_id", (F.col("_all") > join.together).alias("_large")))
    texts = docs.join(F.broadcast(members) if members.count() <= join.broadcast_rows else members, "doc_id")
    labels = _small_groups(_with_sets(texts.filter("NOT _large"), join, "part"), join)
    if not members.filter("_large").isEmpty():
        labels = labels.unionByName(_large_groups(_with_sets(texts.filter("_large"), join, "part"), join))
    rows = rows.drop("sketch")
    labels = classes.join(labels, ["f1", "f2"], "left").select("f1", "f2", F.coalesce("label", "doc_id").alias("component_id"))
    labels = cut(labels)  # so that the join reads two exchanges and the copies of one set can be split
    return rows.join(labels, ["f1", "f2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *(["f1", "f2"] if names else [])
    )


@query(
    "op9_jaccard_join",
    r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT u, v FROM p UNION SELECT r.doc_id, p.v FROM r JOIN p ON r.c = p.u)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(c), s.doc_id))::BIGINT AS component_id
FROM s LEFT JOIN r USING (doc_id) GROUP BY s.doc_id, sh""",
)
def op9_jaccard_join(spark, sf_dir):
    """Documents of three-word shingle similarity 0.9 or more, as components."""
    return near_groups(table(spark, sf_dir, "documents"), Join(width=3, num=90, den=100))
