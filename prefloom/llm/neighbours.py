"""Nearest neighbours by inner product: a vantage-point tree per shard.

Inner products become distances by one more coordinate: x is extended by sqrt(M^2 - |x|^2) (M: the largest norm) and a query
by 0, so the squared distance is |q|^2 + M^2 - 2 q.x and falls as the product rises. Each shard of the vectors builds a
tree: an inner node has a vantage point, the nearer and the farther half of its points and the range of distances in
each half; leaves hold a few points. All queries of a block go down the tree together, each into its nearer child
first. By the triangle inequality a child is at least ``max(lo - d, d - hi)`` away; it is passed over when that bound times
``factor`` exceeds the distance of the k-th neighbour found so far. Factor one is exact; more prunes sooner.

Every vector meets every query: shards and query blocks have a fixed size, and each pair of them is one group of a
bounded number of rows. A pair gives k rows per query, and the best k of all shards are ranked by a window per query.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as query or candidate. Vectors
of different lengths never meet. Null ids take no part. A query's own id is left out, also where it is repeated. Repeated vectors
are ranked by id. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF = 128


@dataclass(frozen=True)
class Search:
    """Neighbours per query, relaxation of the pruning, vectors per shard and queries per block."""

    k: int = 20
    factor: float = 1.0
    shard: int = 16_384
    block: int = 16_384


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed from the first component to the last in double precision."""
    total = np.zeros(len(queries))
    for k in range(queries.shape[1]):
        total += queries[:, k] * vectors[:, k]
    return total


class Tree:
    """Vantage-point tree over extended vectors; ``order`` lists the points leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.root = self._grow(np.arange(len(points)), leaf, np.random.default_rng(len(points)))

    def _grow(self, at: np.ndarray, leaf: int, rng: np.random.Generator) -> tuple:
        if len(at) <= leaf:
            return (at,)
        vantage = int(at[rng.integers(len(at))])
        d = np.sqrt(((self.points[at] - self.points[vantage]) ** 2).sum(1))
        rank = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = rank[:half], rank[half:]
        spans = (d[near].min(), d[near].max(), d[far].min(), d[far].max())
        return vantage, spans, self._grow(at[near], leaf, rng), self._grow(at[far], leaf, rng)


class Beam:
    """The best ``k`` candidates of a block of queries so far."""

    def __init__(self, tree: Tree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, top: float, k: int, factor: float) -> None:
        self.tree, self.vectors, self.ids, self.queries, self.query_ids = tree, vectors, ids, queries, query_ids
        self.k, self.factor = k, factor
        self.far2 = (queries**2).sum(1) + top**2
        self.slack = 1e-9 * (1 + self.far2)
        n = len(queries)
        self.score = np.full((n, k), -np.inf)
        self.found = np.full((n, k), -1, dtype=np.int64)
        self.extended = np.concatenate([queries, np.zeros((n, 1))], axis=1)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Distance of the k-th candidate, with room for rounding."""
        worst = self.score[q, -1]
        with np.errstate(invalid="ignore"):
            return np.where(np.isneginf(worst), np.inf, np.sqrt(np.maximum(self.far2[q] - 2 * worst, 0) + self.slack[q]))

    def visit(self, node: tuple, q: np.ndarray) -> None:
        if not len(q):
            return
        if len(node) == 1:
            self.scan(node[0], q)
            return
        vantage, (near_lo, near_hi, far_lo, far_hi), near, far = node
        d = np.sqrt(((self.extended[q] - self.tree.points[vantage]) ** 2).sum(1))
        to_near = np.maximum(np.maximum(near_lo - d, d - near_hi), 0)
        to_far = np.maximum(np.maximum(far_lo - d, d - far_hi), 0)
        first = to_near <= to_far
        for child, mask, bound in ((near, first, to_near), (far, ~first, to_far), (far, first, to_far), (near, ~first, to_near)):
            asked = q[mask]
            if len(asked):
                self.visit(child, asked[bound[mask] * self.factor <= self.reach(asked)])

    def scan(self, at: np.ndarray, q: np.ndarray) -> None:
        rough = self.queries[q] @ self.vectors[at].T
        keep = rough >= (self.score[q, -1] - self.slack[q])[:, None]
        keep &= self.query_ids[q][:, None] != self.ids[at][None, :]
        row, column = np.nonzero(keep)
        if not len(row):
            return
        who, what = q[row], at[column]
        exact = products(self.queries[who], self.vectors[what])
        touched = np.unique(who)
        who = np.concatenate([who, np.repeat(touched, self.k)])
        ids = np.concatenate([self.ids[what], self.found[touched].reshape(-1)])
        score = np.concatenate([exact, self.score[touched].reshape(-1)])
        rank = np.lexsort((ids, -score, who))
        who, ids, score = who[rank], ids[rank], score[rank]
        start = np.searchsorted(who, touched)
        take = start[:, None] + np.arange(self.k)[None, :]
        self.found[touched], self.score[touched] = ids[take], score[take]


def usable(vector: Column) -> Column:
    """Neither null nor zero nor empty, all components finite."""
    big = F.lit(float("inf"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    return F.coalesce(vector.isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", search: Search = Search()) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest of each row that ``is_query`` holds for."""
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = df.filter(F.col(key).isNotNull()).withColumn("_v", wide).filter(usable(F.col("_v")))
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col("_v").alias("v"), F.size("_v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    # one row per vector length: counts and the largest norm
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("m"), F.max(norm).alias("top"))
    sizes = sizes.select("dim", "top", F.expr(f"cast(ceil(n / {search.shard}) as int)").alias("shards"), F.expr(f"cast(ceil(m / {search.block}) as int)").alias("blocks"))
    # one row per vector length; the pairs of shards and blocks are few and heavy, so they are dealt out one by one
    tasks = sizes.agg(F.sum(F.col("shards") * F.col("blocks"))).first()[0] or 1
    sized = rows.join(sizes, "dim").filter("blocks > 0")
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = sized.select("dim", mine("shards").alias("shard"), each("blocks").alias("block"), "id", "v", "top", F.lit(False).alias("asks"))
    asked = sized.filter("asks").select("dim", each("shards").alias("shard"), mine("blocks").alias("block"), "id", "v", "top", "asks")

    def work(part: pa.Table) -> pa.Table:
        ids = part.column("id").to_numpy()
        v = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        asks = part.column("asks").to_numpy().astype(bool)
        top = float(part.column("top")[0].as_py())
        vectors, vector_ids = v[~asks], ids[~asks]
        if not len(vectors) or not asks.any():
            return _result(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        rest = np.sqrt(np.maximum(top**2 - (vectors**2).sum(1), 0))
        tree = Tree(np.concatenate([vectors, rest[:, None]], axis=1))
        beam = Beam(tree, vectors, vector_ids, v[asks], ids[asks], top, search.k, search.factor)
        beam.visit(tree.root, np.arange(int(asks.sum())))
        got = ~np.isneginf(beam.score)
        return _result(np.repeat(ids[asks], search.k)[got.reshape(-1)], beam.found[got], beam.score[got])

    found = points.union(asked).repartition(2 * int(tasks), "dim", "shard", "block").groupBy("dim", "shard", "block").applyInArrow(work, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= search.k).select("query_id", "rank", "vec_id", "score")


def _result(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.Table:
    return pa.table({"query_id": pa.array(q), "vec_id": pa.array(v), "score": pa.array(s)})


__all__ = ["Beam", "Search", "Tree", "nearest", "products", "usable"]
