"""Nearest neighbours by vantage-point trees, one tree per shard, with triangle-inequality pruning.

Inner product becomes a metric by one more coordinate that brings every candidate to the same norm: the Euclidean order of
candidates around a query is then the order of inner products. A subtree is skipped if ``factor`` times its lower bound on the
distance exceeds the distance of the query's current k-th neighbour; factor 1 is exact, a larger one skips more.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part; a query meets vectors of its own
length only; a null vec_id takes no part; repeated rows are separate candidates; other columns are not read; ties go to the smaller vec_id; fewer candidates than k are all returned;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF = 96


class Tree:
    """A vantage-point tree over the rows of ``points`` (already of equal norm)."""

    def __init__(self, points: np.ndarray, seed: int = 0):
        self.points, self.rng = points, np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = self.points[rows[self.rng.integers(len(rows))]]
        distance = np.sqrt(np.maximum(((self.points[rows] - vantage) ** 2).sum(1), 0))
        radius = np.median(distance)
        near = distance <= radius
        if near.all():
            near = distance < radius
        if not near.any() or near.all():
            return rows
        return vantage, distance[near].max(), distance[~near].min(), self._build(rows[near]), self._build(rows[~near])


def search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, query_rows: np.ndarray, limit: float, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best candidates of each query, best first; missing ones have score -inf."""
    # of equal vectors only the k + 1 of smallest id can be among a query's k (one may be the query itself)
    order = np.lexsort((rows, ids))
    _, same = np.unique(vectors[order].view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    by_group = np.argsort(same, kind="stable")
    rank = np.arange(len(same)) - np.searchsorted(same[by_group], same[by_group])
    keep = order[by_group[rank <= k]]
    vectors, ids, rows = vectors[keep], ids[keep], rows[keep]
    points = np.c_[vectors, np.sqrt(np.maximum(limit - (vectors**2).sum(1), 0))]
    tree = Tree(points)
    n = len(queries)
    norm = (queries**2).sum(1)
    lifted = np.c_[queries, np.zeros(n)]
    best = np.full((n, k), -np.inf)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    slack = 1e-9 * (np.sqrt(limit) + np.sqrt(norm))

    def reach(q: np.ndarray) -> np.ndarray:
        worst = best[q, -1]
        return np.where(np.isneginf(worst), np.inf, np.sqrt(np.maximum(norm[q] + limit - 2 * np.where(np.isneginf(worst), 0, worst), 0))) + slack[q]

    def visit(node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            found = queries[q] @ vectors[node].T
            found[query_rows[q][:, None] == rows[node]] = -np.inf
            score = np.concatenate([best[q], found], 1)
            tag = np.concatenate([best_id[q], np.where(np.isneginf(found), np.iinfo(np.int64).max, ids[node])], 1)
            first = np.lexsort((tag, -score), axis=1)[:, :k]
            best[q], best_id[q] = np.take_along_axis(score, first, 1), np.take_along_axis(tag, first, 1)
            return
        vantage, inner, outer, near, far = node
        distance = np.sqrt(np.maximum(((lifted[q] - vantage) ** 2).sum(1), 0))
        inside = distance <= inner
        visit(near, q[inside])
        visit(far, q[~inside])
        late = inside & (factor * (outer - distance) <= reach(q))
        visit(far, q[late])
        late = ~inside & (factor * (distance - inner) <= reach(q))
        visit(near, q[late])

    visit(tree.root, np.arange(n))
    return best, best_id


def valid_vectors(table: DataFrame, id_column: str, column: str) -> DataFrame:
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), F.monotonically_increasing_id().alias("row"))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull()).filter(finite & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size(v))


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(table: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, factor: float = 1.1, shard_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by ``every``.

    Every (shard, block of queries) is one task of bounded size; its k best per query are merged by query. The number of such
    tasks is rows / shard_rows * queries / query_rows, as the query set is stated against all rows.
    """
    rows = materialize(valid_vectors(table, id_column, column))
    n, limit = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    asked = rows.filter(F.col("id") % every == 0)
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-asked.count() // query_rows))
    limit = float(limit or 0.0) * (1 + 1e-12)
    spread = F.xxhash64("row")
    data = rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = asked.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        q_ids, q_rows = right.column("id").to_numpy(), right.column("row").to_numpy()
        score, found = search(_matrix(left), left.column("id").to_numpy(), left.column("row").to_numpy(), _matrix(right), q_rows, limit, k, factor)
        at, place = np.nonzero(~np.isneginf(score))
        return pa.table({"query_row": q_rows[at], "query_id": q_ids[at], "vec_id": found[at, place], "score": score[at, place]})

    keys = ("dim", "shard", "block")
    parts = data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(task, "query_row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
