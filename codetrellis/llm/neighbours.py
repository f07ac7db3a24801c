"""Nearest neighbours by a block matrix join over int8 codes.

Queries and candidates are dealt into blocks; a pair of blocks is one tile. A
tile's int8 product gives every inner product with an error bound; pairs whose
upper bound reaches the query's k-th best lower bound survive, are recomputed in
double precision and merged by heaps. The result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrellis.llm.registry import query, table

HIT_FIELDS = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, dims, vector`` of the rows that take part.

    Left out: null ids, vectors that are null, empty, zero, or hold a null or
    non-finite component. Rows that repeat an id are all kept.
    """
    v = F.col(vector_col).cast("array<double>")
    limit = F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("vec_id"), F.size(vector_col).alias("dims"), F.col(vector_col).alias("vector")
    )


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the norms of the coded vectors and of what coding lost."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.sqrt((coded * coded).sum(axis=1)), np.sqrt(((x - coded) ** 2).sum(axis=1))


def int8_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 codes: float32 sums stay whole below 2^24, so 1024 dims at a time."""
    total = np.zeros((len(a), len(b)), np.float64)
    for d in range(0, a.shape[1], 1024):
        total += a[:, d : d + 1024].astype(np.float32) @ b[:, d : d + 1024].astype(np.float32).T
    return total


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed in component order."""
    total = np.zeros(len(q))
    for d in range(q.shape[1]):
        total += q[:, d] * c[:, d]
    return total


def nearest(k: int, scores: np.ndarray, ids: np.ndarray) -> list[tuple[float, int]]:
    """(-score, id) of the k best ids, each by its best score; ties go to the smaller id."""
    best: dict[int, float] = {}
    for score, i in zip(scores.tolist(), ids.tolist()):
        if score > best.get(i, -np.inf):
            best[i] = score
    return heapq.nsmallest(k, ((-score, i) for i, score in best.items()))


def tile_hits(query_ids, q, vec_ids, c, k: int, rows: int = 256):
    """Each query row's k nearest ids among the candidates of one tile: lists (query, vec, score).

    An id that several candidates have counts once, by its best one.
    """
    order = np.argsort(vec_ids, kind="stable")
    vec_ids, c = vec_ids[order], c[order]
    heads = np.flatnonzero(np.diff(vec_ids, prepend=vec_ids[:1] - 1)) if len(vec_ids) else np.zeros(0, np.int64)
    codes_c, scale_c, norm_c, lost_c = quantise(c)
    out = ([], [], [])
    for at in range(0, len(q), rows):
        part, ids = q[at : at + rows], query_ids[at : at + rows]
        codes, scale, norm, lost = quantise(part)
        about = int8_product(codes, codes_c) * scale[:, None] * scale_c
        # |<x,y> - <x',y'>| <= |x'||y-y'| + |y'||x-x'| + |x-x'||y-y'|; the last term covers rounding
        error = norm[:, None] * lost_c + lost[:, None] * (norm_c + lost_c)
        error += 1e-12 * (norm + lost)[:, None] * (norm_c + lost_c)
        own = ids[:, None] == vec_ids
        low, high = about - error, about + error
        low[own], high[own] = -np.inf, -np.inf
        if len(heads) > k:
            each = low if len(heads) == len(vec_ids) else np.maximum.reduceat(low, heads, axis=1)
            kth = -np.partition(-each, k - 1, axis=1)[:, k - 1]
            alive = (high >= kth[:, None]) & ~own
        else:
            alive = ~own
        for i in range(len(part)):
            js = np.flatnonzero(alive[i])
            if not len(js):
                continue
            scores = exact_scores(np.broadcast_to(part[i], (len(js), part.shape[1])), c[js])
            best = nearest(k, scores, vec_ids[js])
            out[0].extend([int(ids[i])] * len(best))
            out[1].extend(v for _, v in best)
            out[2].extend(-s for s, _ in best)
    return out


def search(
    vectors: DataFrame,
    is_query,
    k: int = 20,
    query_block: int = 4096,
    candidate_block: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest candidates of every query.

    ``is_query`` is a condition on the column ``vec_id``; every usable row but the
    query itself is a candidate. Nearness is the inner product, ties go to the
    smaller id. Rows that share an id stand for it together: a pair of ids has the best score of any of
    their rows, and rows of the query's own id are no candidates. Vectors of different lengths are not compared. A tile holds
    ``query_block`` by ``candidate_block`` vectors on average, whatever the table's
    size, and each tile hands on k rows a query; equal vectors cost no more than others.
    """
    rows = usable(vectors, id_col, vector_col)
    counts = rows.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    of_candidates = max(1, -(-counts[0] // candidate_block))
    of_queries = max(1, -(-counts[1] // query_block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return df.select(
            F.col("dims").alias("_d"),
            F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other),
            F.col("vec_id").alias("_id"),
            F.col("vector").alias("_vec"),
        )

    queries = dealt(rows.filter(is_query), "_q", of_queries, "_c", of_candidates)
    candidates = dealt(rows, "_c", of_candidates, "_q", of_queries)

    def tile(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            dims = int(key[0].as_py())
            found = tile_hits(
                left["_id"].to_numpy(), _matrix(left["_vec"], dims),
                right["_id"].to_numpy(), _matrix(right["_vec"], dims), k,
            )
        else:
            found = ([], [], [])
        return pa.table(
            {"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())}
        )

    keys = ["_d", "_q", "_c"]
    hits = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(tile, HIT_FIELDS)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        best = nearest(k, table["score"].to_numpy(), table["vec_id"].to_numpy())
        return pa.table(
            {
                "query_id": pa.array([key[0].as_py()] * len(best), pa.int64()),
                "rank": pa.array(range(1, len(best) + 1), pa.int32()),
                "vec_id": pa.array([v for _, v in best], pa.int64()),
                "score": pa.array([-s for s, _ in best], pa.float64()),
            }
        )

    return hits.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


@query(
    "op2_nearest",
    """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.e, c.e)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0 GROUP BY ALL)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM p QUALIFY rank <= 20""",
)
def op2_nearest(spark, sf_dir):
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
