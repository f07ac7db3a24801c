"""The trie of conversation prefixes, read from sorted conversations without building it.

Conversations are sorted by their turns, each is given the number of turns it shares
with the one before it (LCP), and a sparse table of range minima over these numbers
answers every question: the prefix of d turns that a conversation begins is shared by
all those up to the first smaller LCP on its right, and its parent by those from the last
smaller one on the left. Both ends are found by binary search on the table, each for itself.

The order is cut into blocks of ranks. A block has a table of its own; a table over the minima
of all blocks says in which block an interval that leaves its own ends, and that
block's answers, one for each depth that is open where it begins or ends, are joined in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table
from codetrellis.session import checkpointed as cut, distributed_rank


@dataclass(frozen=True)
class Blocks:
    """Conversations a block, and how many blocks there may be; blocks grow beyond that.

    The driver sees four numbers a block. Neither changes the result.
    """

    size: int = 1 << 14
    most: int = 1 << 16

    def step(self, rows: int) -> int:
        return max(self.size, -(-rows // self.most))


class Minima:
    """Sparse table: minima of all ranges whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels, self.n = [np.asarray(values, np.int64)], len(values)
        while (1 << len(self.levels)) <= self.n:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First place from ``start`` on that is below ``depth``, or the end."""
        at = np.array(start, np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(at + (1 << k) <= self.n)
            fits = fits[self.levels[k][at[fits]] >= depth[fits]]
            at[fits] += 1 << k
        return at

    def left(self, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last place up to ``end`` that is below ``depth``, or -1."""
        at = np.array(end, np.int64) + 1
        for k in range(len(self.levels) - 1, -1, -1):
            fits = np.flatnonzero(at >= 1 << k)
            fits = fits[self.levels[k][at[fits] - (1 << k)] >= depth[fits]]
            at[fits] -= 1 << k
        return at - 1

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of every [start, end); the greatest number for an empty range."""
        out = np.full(len(start), np.iinfo(np.int64).max)
        size = end - start
        for k in range(len(self.levels)):
            some = np.flatnonzero((size >= 1 << k) & ((size >> (k + 1)) == 0))
            out[some] = np.minimum(self.levels[k][start[some]], self.levels[k][end[some] - (1 << k)])
        return out


@dataclass
class Outline:
    """What is known of all blocks: the first and the least LCP, the smallest id, the number of members."""

    first: np.ndarray
    least: np.ndarray
    low: np.ndarray
    members: np.ndarray
    rows: int
    step: int

    def base(self, block: int) -> int:
        return block * self.step

    def open_after(self, block: int) -> int:
        """Greatest depth that goes on behind a block; -1 behind the last."""
        return int(self.first[block + 1]) if block + 1 < len(self.first) else -1


# --- from rows to sorted sequences ------------------------------------------------


def numbered_turns(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, d, name, size`` of every row: its number in the conversation from 1, a 128-bit
    name of role and text, and the bytes of the text.

    Null roles and texts become empty. Rows are ordered by the order column, null first; ties by
    the beginnings of role and text, then by the name. Rows are numbered over ranges, so
    one conversation may hold most of them; rows without an id are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    narrow = rows.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(order_col).alias("_turn"),
        F.left(role, F.lit(64)).alias("_role"),
        F.left(text, F.lit(64)).alias("_begin"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("name"),
        F.octet_length(text).cast("long").alias("size"),
    )
    keys = ["conv_id", F.col("_turn").asc_nulls_first(), "_role", "_begin", "name"]
    placed = cut(
        narrow.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("conv_id", "name", "size", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_pos"))
    )
    pieces = placed.groupBy("conv_id", "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("conv_id", "_part", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return placed.join(starts, ["conv_id", "_part"]).select("conv_id", (F.col("_pos") + F.col("_shift")).alias("d"), "name", "size")


def sequences(turns: DataFrame, ids: DataFrame, order: list[str]) -> DataFrame:
    """``conv_id, names, sizes``: one row for every conv_id of ``ids``, turnless ones too."""
    turn = F.struct(*order, "name", "size")
    every = turns.select("conv_id", turn.alias("_t")).unionByName(
        ids.select("conv_id", F.lit(None).cast(turns.select(turn.alias("_t")).schema["_t"].dataType).alias("_t"))
    )
    held = every.groupBy("conv_id").agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    return held.select("conv_id", F.col("_t.name").alias("names"), F.col("_t.size").alias("sizes"))


# --- the order and its LCPs --------------------------------------------------------


def shared_lengths(ranked: DataFrame, step: int) -> DataFrame:
    """``block, rank, lcp, n, members, conv_id, sizes, class`` in place of the names; the first LCP is -1."""
    block = F.floor(F.col("rank") / step).cast("long")
    own = ranked.withColumn("block", block).withColumn("own", F.lit(True))
    before = ranked.filter(F.col("rank") % step == step - 1).withColumn("block", block + 1).withColumn("own", F.lit(False))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank").combine_chunks()
        names = rows["names"].combine_chunks()
        bounds = names.offsets.to_numpy().astype(np.int64)
        code = names.flatten().dictionary_encode().indices.to_numpy()
        bounds = bounds - bounds[0]
        n = np.diff(bounds)
        lcp = np.minimum(n[1:], n[:-1])
        row = np.repeat(np.arange(len(lcp)), lcp)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lcp) - lcp, lcp)
        differ = np.flatnonzero(code[bounds[row] + at] != code[bounds[row + 1] + at])
        np.minimum.at(lcp, row[differ], at[differ])
        out = rows.drop_columns(["names", "own"])
        out = out.set_column(out.schema.get_field_index("sizes"), "sizes", out["sizes"].cast(pa.list_(pa.int64())))
        out = out.append_column("lcp", pa.array(np.concatenate([[-1], lcp]), pa.int64()))
        out = out.append_column("n", pa.array(n, pa.int64()))
        return out.filter(rows["own"]).select(["block", "rank", "lcp", "n", "members", "conv_id", "sizes", "class"])

    return own.unionByName(before).groupBy("block").applyInArrow(
        compare, "block long, rank long, lcp long, n long, members long, conv_id long, sizes array<long>, class string"
    )


def outline(lengths: DataFrame, rows: int, step: int) -> Outline:
    found = lengths.groupBy("block").agg(
        F.min_by("lcp", "rank").alias("first"), F.min("lcp").alias("least"), F.min("conv_id").alias("low"), F.sum("members").alias("members")
    )
    found = sorted(found.collect())  # at most Blocks.most rows
    first, least, low, members = (np.array([r[i] for r in found], np.int64) for i in range(1, 5))
    return Outline(first, least, low, members, rows, step)


# --- intervals that leave their block -----------------------------------------------

SIDE_FIELDS = "side int, block long, d long, rank long, low long, members long"


def ends_within(lengths: DataFrame, whole: Outline) -> DataFrame:
    """SIDE_FIELDS of each block, for the intervals that come in and end there.

    Side 1: the last rank of depth ``d`` of what was open where the block begins, with the smallest id
    and the members up to there. Side 0: the first rank of what is open where the block ends.
    """

    def ends(key: tuple, rows: pa.Table) -> pa.Table:
        block = int(key[0].as_py())
        rows = rows.sort_by("rank")
        lcp, low = Minima(rows["lcp"].to_numpy()), Minima(rows["conv_id"].to_numpy())
        total = np.concatenate([[0], np.cumsum(rows["members"].to_numpy())])
        least, base = int(whole.least[block]), whole.base(block)
        came = np.arange(least + 1, int(whole.first[block]) + 1)
        goes = np.arange(least + 1, whole.open_after(block) + 1)
        end, start = lcp.right(np.zeros(len(came), np.int64), came), lcp.left(np.full(len(goes), lcp.n - 1), goes)
        low_came = low.least(np.zeros(len(came), np.int64), end)
        low_goes = low.least(start, np.full(len(goes), lcp.n))
        return pa.table(
            {
                "side": pa.array(np.repeat([1, 0], [len(came), len(goes)]), pa.int32()),
                "block": pa.array(np.full(len(came) + len(goes), block)),
                "d": pa.array(np.concatenate([came, goes])),
                "rank": pa.array(np.concatenate([base + end - 1, base + start])),
                "low": pa.array(np.concatenate([low_came, low_goes])),
                "members": pa.array(np.concatenate([total[end], np.zeros(len(goes), np.int64)])),
            }
        )

    return lengths.select("block", "rank", "lcp", "conv_id", "members").groupBy("block").applyInArrow(ends, SIDE_FIELDS)


def boundaries(lengths: DataFrame, whole: Outline) -> DataFrame:
    """SIDE_FIELDS of what lies outside of each block of the intervals that reach over its edge.

    Side 0: of depth ``d`` open where the block begins, the first rank, and the smallest id before the
    block. Side 1: of depth ``d`` open where it ends, the last rank, and the smallest id and members behind it.
    """
    blocks = len(whole.first)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, low = Minima(whole.least), Minima(whole.low)
        total = np.concatenate([[0], np.cumsum(whole.members)])
        for batch in batches:
            for b in batch.column(0).to_pylist():
                came, goes = np.arange(0, int(whole.first[b]) + 1), np.arange(0, whole.open_after(b) + 1)
                start = least.left(np.full(len(came), b - 1), came)
                end = least.right(np.full(len(goes), b + 1), goes)
                none = np.zeros(len(came), np.int64)
                # what ends with the first rank of a block, or never, is known without asking the block
                last = np.where(end < blocks, np.minimum(end * whole.step, whole.rows), whole.rows) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [len(came), len(goes)]), pa.int32()),
                        pa.array(np.full(len(came) + len(goes), b)),
                        pa.array(np.concatenate([came, goes])),
                        pa.array(np.concatenate([start, end])),
                        pa.array(np.concatenate([low.least(start + 1, none + b), low.least(np.full(len(goes), b + 1), end)])),
                        pa.array(np.concatenate([none, total[end] - total[b + 1]])),
                        pa.array(np.concatenate([none, last])),
                    ],
                    ["side", "block", "d", "_to", "_low", "_members", "_last"],
                )

    asked = lengths.sparkSession.range(blocks).mapInArrow(ask, "side int, block long, d long, _to long, _low long, _members long, _last long")
    inside = ends_within(lengths, whole).select(
        "side", F.col("block").alias("_to"), "d", "rank", F.col("low").alias("_more"), F.col("members").alias("_plus")
    )
    return asked.join(inside, ["side", "_to", "d"], "left").select(
        "side",
        "block",
        "d",
        F.coalesce("rank", "_last").alias("rank"),
        F.least("_low", F.coalesce("_more", "_low")).alias("low"),
        (F.col("_members") + F.coalesce("_plus", F.lit(0))).alias("members"),
    )


# --- nodes -------------------------------------------------------------------------

NODE_FIELDS = (
    "block long, start long, d long, end long, conv_id long, n_convs long, size long, goes_on boolean, "
    "fresh boolean, parent_start long, parent_conv_id long, class string"
)


def intervals(lengths: DataFrame, edges: DataFrame, whole: Outline) -> DataFrame:
    """NODE_FIELDS of every node, where its first conversation in the order stands.

    ``start`` and ``end`` are the first and last rank of its members. ``fresh`` marks a conversation's first
    node of its own; the parent of that one began with an earlier conversation.
    """

    def nodes(key: tuple, rows: pa.Table, edge: pa.Table) -> pa.Table:
        block = int(key[0].as_py())
        rows = rows.sort_by("rank").combine_chunks()
        lcp, n = rows["lcp"].to_numpy(), rows["n"].to_numpy()
        share, low = Minima(lcp), Minima(rows["conv_id"].to_numpy())
        total = np.concatenate([[0], np.cumsum(rows["members"].to_numpy())])
        last, base, after = len(lcp), whole.base(block), whole.open_after(block)
        edge = edge.sort_by([("side", "ascending"), ("d", "ascending")])  # every depth from 0 on once
        side = edge["side"].to_numpy()
        outside = {s: {c: edge[c].to_numpy()[side == s] for c in ("rank", "low", "members")} for s in (0, 1)}

        def to_the_right(at: np.ndarray, depth: np.ndarray):
            """End in the block, last rank, and smallest id and members behind the block."""
            end = share.right(at + 1, depth)
            rank, more, plus = base + end - 1, np.full(len(at), np.iinfo(np.int64).max), np.zeros(len(at), np.int64)
            over = np.flatnonzero((end == last) & (depth >= 0) & (depth <= after))
            rank[over], more[over], plus[over] = (outside[1][c][depth[over]] for c in ("rank", "low", "members"))
            return end, rank, more, plus

        new = n - lcp
        at = np.repeat(np.arange(last), new)
        depth = np.arange(len(at)) - np.repeat(np.cumsum(new) - new, new) + lcp[at] + 1
        end, rank, more, plus = to_the_right(at, depth)
        least = np.minimum(low.least(at, end), more)
        fresh = depth == lcp[at] + 1
        parent, above = base + at, np.roll(least, 1)
        # a conversation's first node: its parent's left and right ends
        one = np.flatnonzero(fresh)
        k, d = at[one], lcp[at[one]]
        begin = share.left(k, d)
        far = np.flatnonzero((begin < 0) & (d >= 0))
        stop, _, more, _ = to_the_right(k, d)
        smallest = np.minimum(low.least(np.maximum(begin, 0), stop), more)
        begin = base + begin
        begin[far] = outside[0]["rank"][d[far]]
        smallest[far] = np.minimum(smallest[far], outside[0]["low"][d[far]])
        parent[one], above[one] = begin, smallest
        top = depth == 0
        sizes = rows["sizes"].combine_chunks()
        bounds = sizes.offsets.to_numpy().astype(np.int64)
        flat = np.append(sizes.flatten().to_numpy(zero_copy_only=False), 0)
        place = np.where(top, len(flat) - 1, bounds[at] - bounds[0] + depth - 1)
        ended = depth == n[at]
        return pa.table(
            {
                "block": pa.array(np.full(len(at), block)),
                "start": pa.array(base + at),
                "d": pa.array(depth),
                "end": pa.array(rank),
                "conv_id": pa.array(least),
                "n_convs": pa.array(total[end] - total[at] + plus),
                "size": pa.array(flat[place].astype(np.int64)),
                "goes_on": pa.array(~ended),
                "fresh": pa.array(fresh),
                "parent_start": pa.array(parent, mask=top),
                "parent_conv_id": pa.array(above, mask=top),
                "class": rows["class"].combine_chunks().take(pa.array(np.where(ended, at, 0), mask=~ended)),
            }
        )

    left = lengths.groupBy("block")
    return left.cogroup(edges.groupBy("block")).applyInArrow(nodes, NODE_FIELDS)


def member_digests(members: DataFrame, ids_a_chunk: int = 4096) -> DataFrame:
    """``class, ends_sha256``: SHA-256 of each class's conv_ids, ascending, comma-joined.

    ``members(class, conv_id)`` are dealt by range and joined to chunks of text, which alone meet by class
    and run through the digest one after the other; so a class may hold most rows.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).dictionary_encode().indices.to_numpy()
            ids = batch.column(1).to_pylist()
            cuts = np.flatnonzero(np.diff(code, prepend=-1)).tolist() + [len(ids)]
            parts = [(a, min(a + ids_a_chunk, z)) for x, z in zip(cuts, cuts[1:]) for a in range(x, z, ids_a_chunk)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([a for a, _ in parts], pa.int64())),
                    pa.array([ids[a] for a, _ in parts], pa.int64()),
                    pa.array([",".join(map(str, ids[a:z])) for a, z in parts], pa.string()),
                ],
                ["class", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, names, out = None, None, [], []
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != now:
                    if sha is not None:
                        names.append(now)
                        out.append(sha.hexdigest())
                    now, sha = name, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], ["class", "ends_sha256"])
            names, out = [], []
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([sha.hexdigest()])], ["class", "ends_sha256"])

    keys = ["class", "conv_id"]
    pieces = members.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(chunks, "class string, first long, ids string")
    return pieces.repartition("class").sortWithinPartitions("class", "first").mapInArrow(digest, "class string, ends_sha256 string")


def _running(nodes: DataFrame) -> DataFrame:
    """``rank, leaves, saved``: sums over the nodes that begin at all ranks up to this one."""
    each = nodes.groupBy("block", F.col("start").alias("rank")).agg(F.sum("leaf").alias("_l"), F.sum("saved").alias("_s"))
    each = cut(each)
    blocks = each.groupBy("block").agg(F.sum("_l").alias("_bl"), F.sum("_s").alias("_bs"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most Blocks.most rows
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_bl", "_bs")])
    upto = Window.partitionBy("block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    each = each.select("block", "rank", F.sum("_l").over(upto).alias("_l"), F.sum("_s").over(upto).alias("_s"))
    return each.join(blocks, "block").select("rank", (F.col("_l") + F.col("_bl")).alias("leaves"), (F.col("_s") + F.col("_bs")).alias("saved"))


def prefix_trie(convs: DataFrame, spec: Blocks = Blocks()) -> DataFrame:
    """Nodes of the trie of ``convs(conv_id, names, sizes)``, one row each.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (over the subtree, each node's (n_convs - 1) times the size of its last turn) and
    ``ends_sha256``. Equal sequences are one member with a count, so that copies cost one row each; an empty
    table gives no node, a turnless conversation ends at the root. A conversation's names (some 50
    bytes a turn) must fit in a row.
    """
    named = cut(convs.withColumn("class", F.md5(F.array_join("names", "").cast("binary"))))
    classes = named.groupBy("class").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("members"), F.first("names").alias("names"), F.first("sizes").alias("sizes")
    )
    ranked = cut(distributed_rank(classes, [], ["names"], "rank"))
    rows = ranked.count()
    step = spec.step(rows)
    lengths = cut(shared_lengths(ranked, step))
    whole = outline(lengths, rows, step)
    nodes = intervals(lengths, cut(boundaries(lengths, whole)), whole)
    ends = ~F.col("goes_on") & (F.col("start") == F.col("end"))
    nodes = cut(nodes.withColumn("leaf", ends.cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("size")))
    running = cut(_running(nodes))
    kids = nodes.filter("fresh AND d > 0").groupBy(F.col("parent_start").alias("start"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("_kids"))
    own = Window.partitionBy("start").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    here = running.select(F.col("rank").alias("start"), F.col("leaves").alias("_l0"), F.col("saved").alias("_s0"))
    there = running.select(F.col("rank").alias("end"), F.col("leaves").alias("_l1"), F.col("saved").alias("_s1"))
    found = (
        nodes.withColumn("_l", F.sum("leaf").over(own))
        .withColumn("_s", F.sum("saved").over(own))
        .join(here, "start")
        .join(kids, ["start", "d"], "left")
        .join(there, "end")
        .join(member_digests(named), "class", "left")
    )
    return found.select(
        "conv_id",
        F.col("d").alias("depth"),
        "parent_conv_id",
        "n_convs",
        (F.coalesce("_kids", F.lit(0)) + F.col("goes_on").cast("long")).alias("n_children"),
        (F.col("_l1") - F.col("_l0") + F.col("_l")).alias("n_leaves"),
        (F.col("_s1") - F.col("_s0") + F.col("_s")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, names, sizes`` of conversations that begin with turns of a neighbour.

    Conversation c takes the first h turns of conversation c - c % 5 (``%`` as in SQL), then its own after
    its first h; h is the crc32 of the decimal c, modulo 9. So at most eight turns of one go to five others.
    """
    ids = turns.select("conv_id").distinct()
    own = turns.filter(F.col("d") > _shared_turns(F.col("conv_id"))).withColumn("part", F.lit(1))
    lent = turns.filter((F.col("conv_id") % 5 == 0) & (F.col("d") <= 8)).withColumnRenamed("conv_id", "_from")
    lent = lent.withColumn("conv_id", F.explode(F.sequence(F.col("_from") - 4, F.col("_from") + 4)))
    lent = lent.filter((F.col("conv_id") - F.col("conv_id") % 5 == F.col("_from")) & (F.col("d") <= _shared_turns(F.col("conv_id"))))
    lent = lent.join(ids, "conv_id", "left_semi").withColumn("part", F.lit(0)).select(*own.columns)
    return sequences(own.unionByName(lent), ids, ["part", "d"])


_SQL = """
WITH z AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
ids AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: xor(c >> 8, z[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), z),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS name FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, name, strlen(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64), name) AS d FROM t),
r AS (SELECT ids.conv_id, 0 AS part, d, name, size FROM ids JOIN n ON n.conv_id = ids.conv_id - ids.conv_id % 5 AND d <= h
  UNION ALL SELECT conv_id, 1, d, name, size FROM n JOIN ids USING (conv_id) WHERE d > h),
p AS (SELECT conv_id, size, string_agg(name, '') OVER w AS path, row_number() OVER w AS depth FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, d ROWS UNBOUNDED PRECEDING)),
q AS (SELECT conv_id, path, depth, size FROM p UNION ALL SELECT conv_id, '', 0, 0 FROM ids),
ends AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(path, depth) AS path FROM q GROUP BY conv_id) GROUP BY path),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM q GROUP BY path, depth),
kids AS (SELECT left(path, length(path) - 32) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_ AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (path)),
sub AS (SELECT left(path, 32 * i) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS i FROM full_) GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ends.ids, '')) AS ends_sha256
FROM full_ f JOIN sub USING (path) LEFT JOIN ends USING (path)
LEFT JOIN node up ON f.depth > 0 AND up.path = left(f.path, length(f.path) - 32)"""


@query("op13_prefix_trie", _SQL)
def op13_prefix_trie(spark, sf_dir):
    """Every node of the trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(numbered_turns(table(spark, sf_dir, "conversations"))))
