"""Exact search for the largest integer inner products, by buckets of vector length.

Components become whole numbers, ``floor(scale * x)``. Vectors are grouped by their length (norm): level L holds the lengths from ``1/ratio**L``
on, so no vector of a bucket is shorter than ``ratio`` times its longest one. A query that has k products of ``theta`` at least
can only gain from a bucket of length l by a cosine of ``theta / (|q| l)`` at least: the local threshold. Over one, the
bucket is passed over. Otherwise the threshold chooses how the bucket is read:

* by coordinate, where the threshold is high: with unit vectors q and p of cosine t or more, each coordinate of p lies within
  ``t q_f -+ sqrt((1 - t^2) (1 - q_f^2))``. The bucket keeps each coordinate sorted, so the candidates of the query's largest coordinates are intervals, the
  shortest of which is taken and held against the others;
* by length, where it is low or the intervals are not much shorter: candidates are the vectors that are long enough, a prefix of the bucket.

Candidates are verified by their products in whole numbers. Pruning is by bounds with room for rounding, so the result is exact.

On Spark: a level is dealt out in shards of about ``shard`` rows by a hash of the stored row, whatever its id, and queries in blocks; each pair of
shard and block is one group of bounded size. First every query meets one shard of the longest well-filled level, which gives it a
threshold; then it is sent only to the shards of levels that can still matter, a range of levels that follows from a formula. Found rows, k for
each query and shard, are ranked by a window per query, whose rows are cut to k in each task before they are shuffled.

Cases: vectors that are null or hold null or non-finite components take no part; zero and empty vectors do. Vectors of different numbers of components
never meet. Null ids take no part. A query's own id is left out, also where it is repeated; of equal rows (id and vector) that ask, one is answered. Repeated candidates
are ranked one by one, ties by id. A product beyond a long counts as the nearest long. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.session import keep

#: below this, sums of whole numbers are exact in double precision
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
#: room for rounding in the bounds
SLACK = 1e-9


@dataclass(frozen=True)
class TopK:
    """Results per query, scale of the components, least length in a bucket by its longest, local threshold from which coordinates are
    looked at, how many of them, share of a bucket above which intervals do not pay, vectors per shard, queries per block, cells of products held at once."""

    k: int = 5
    scale: float = 256.0
    ratio: float = 0.9
    coordinate_from: float = 0.5
    focus: int = 3
    share: float = 0.1
    shard: int = 16_384
    block: int = 16_384
    cells: int = 1 << 22

    def level(self, norm: Column) -> Column:
        """Bucket of a length; longer ones have a larger number, zero has the least."""
        return F.when(norm <= 0, F.lit(-1 << 20)).otherwise(F.floor(F.log(norm) / -math.log(self.ratio)).cast("int"))


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(vectors * scale) + 0.0


def lengths(vectors: np.ndarray) -> np.ndarray:
    """Norms of the rows; large components are scaled first, so that squares do not overflow."""
    if not vectors.shape[1]:
        return np.zeros(len(vectors))
    most = np.maximum(np.abs(vectors).max(1), 1.0)
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(1))


def as_floats(score: np.ndarray) -> np.ndarray:
    if score.dtype != object:
        return score
    return score.astype(float)


def products(q: np.ndarray, v: np.ndarray, top: float) -> np.ndarray:
    """Exact products, queries x vectors; ``top`` bounds their size. Beyond double precision whole numbers of any size are used, and
    what exceeds a long is the nearest long."""
    if top < EXACT:
        return q @ v.T
    a, b = (np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (q, v))
    return np.minimum(np.maximum(a @ b.T, -LONG - 1), LONG)


class Bucket:
    """Vectors of about one length, longest first, equal ones by id."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        norm = lengths(vectors)
        order = np.lexsort((ids, -norm))
        self.vectors, self.ids, self.norm = vectors[order], ids[order], norm[order]
        self.longest = float(self.norm[0]) if len(ids) else 0.0
        self.unit = self.vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows by their coordinate f, and the sorted coordinates."""
        if f not in self.sorted:
            rows = np.argsort(self.unit[:, f], kind="stable")
            self.sorted[f] = rows, self.unit[rows, f]
        return self.sorted[f]


class Best:
    """The ``k`` best of each query of a block so far."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray, exact: bool) -> None:
        n = len(queries)
        self.queries, self.ids, self.k = queries, query_ids, k
        self.norm = lengths(queries)
        self.floor = floor  # k products of this size are known from elsewhere
        self.score = np.full((n, k), -np.inf, dtype=float if exact else object)
        self.found = np.full((n, k), np.iinfo(np.int64).max)

    def theta(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.floor[q], as_floats(self.score[q, -1]))

    def offer(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Products (query, id, score) in any order; a query's own id is left out."""
        fine = (self.ids[q] != ids) & (score >= self.floor[q])
        fine &= (score > self.score[q, -1]) | ((score == self.score[q, -1]) & (ids < self.found[q, -1]))
        q, ids, score = q[fine], ids[fine], score[fine]
        if not len(q):
            return
        touched = np.unique(q)
        q = np.concatenate([q, np.repeat(touched, self.k)])
        ids = np.concatenate([ids, self.found[touched].reshape(-1)])
        score = np.concatenate([score, self.score[touched].reshape(-1)])
        rank = np.lexsort((ids, -score, q)) if score.dtype != object else np.array(sorted(range(len(q)), key=lambda i: (q[i], -score[i], ids[i])))
        q, ids, score = q[rank], ids[rank], score[rank]
        take = np.searchsorted(q, touched)[:, None] + np.arange(self.k)[None, :]
        self.found[touched], self.score[touched] = ids[take], score[take]


def by_length(bucket: Bucket, best: Best, q: np.ndarray, need: np.ndarray, cells: int) -> None:
    """Queries ``q`` against the vectors that are at least ``need`` long."""
    reach = np.searchsorted(-bucket.norm, -need * (1 - SLACK), side="right")
    order = np.argsort(-reach, kind="stable")
    q, reach = q[order], reach[order]
    top = bucket.longest * float(best.norm[q].max(initial=0))
    at = 0
    while at < len(q) and reach[at]:
        step = max(1, cells // int(reach[at]))
        some, n = q[at : at + step], int(reach[at])
        for s in range(0, n, cells):
            part = slice(s, min(n, s + cells))
            score = products(best.queries[some], bucket.vectors[part], top)
            # ties count only with a smaller id than the last one found
            last, bound = best.score[some, -1][:, None], best.floor[some][:, None]
            if score.dtype != object and score.shape[1] > best.k:
                # a query's own id may stand in any number of rows; of the others, the k largest bound the rest
                score[best.ids[some][:, None] == bucket.ids[part][None, :]] = -np.inf
                bound = np.maximum(bound, np.partition(score, -best.k, axis=1)[:, [-best.k]])
            hit = (score >= bound) & ((score > last) | ((score == last) & (bucket.ids[part][None, :] < best.found[some, -1][:, None])))
            row, column = np.nonzero(hit)
            best.offer(some[row], bucket.ids[part][column], score[row, column])
        at += step


def by_coordinate(bucket: Bucket, best: Best, q: np.ndarray, local: np.ndarray, focus: int, share: float) -> np.ndarray:
    """Queries ``q`` with local thresholds ``local``; returns those whose intervals are too long to pay."""
    unit = best.queries[q] / best.norm[q][:, None]
    chosen = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :focus]
    value = np.take_along_axis(unit, chosen, axis=1)
    spread = np.sqrt(np.maximum(1 - value**2, 0) * np.maximum(1 - local**2, 0)[:, None])
    low, high = value * local[:, None] - spread - SLACK, value * local[:, None] + spread + SLACK
    # a cosine above the threshold widens nothing on the outer side, where the query's own coordinate lies beyond the interval
    low, high = np.where(value < -local[:, None], -1 - SLACK, low), np.where(value > local[:, None], 1 + SLACK, high)
    first, last = np.zeros(chosen.shape, np.int64), np.zeros(chosen.shape, np.int64)
    for f in np.unique(chosen):
        _, sorted_ = bucket.coordinate(int(f))
        row, column = np.nonzero(chosen == f)
        first[row, column] = np.searchsorted(sorted_, low[row, column], side="left")
        last[row, column] = np.searchsorted(sorted_, high[row, column], side="right")
    size = last - first
    least = size.argmin(1)
    pays = size.min(1) <= share * len(bucket.ids)
    for i in np.flatnonzero(pays):
        f = least[i]
        rows = bucket.coordinate(int(chosen[i, f]))[0][first[i, f] : last[i, f]]
        for g in range(chosen.shape[1]):
            if g != f and len(rows):
                x = bucket.unit[rows, chosen[i, g]]
                rows = rows[(x >= low[i, g]) & (x <= high[i, g])]
        if len(rows):
            score = products(best.queries[q[i] : q[i] + 1], bucket.vectors[rows], bucket.longest * float(best.norm[q[i]]))[0]
            best.offer(np.full(len(rows), q[i]), bucket.ids[rows], score)
    return q[~pays]


def search(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, top: TopK) -> Best:
    """The best of one shard for one block of queries; ``floor`` holds products that k others are known to reach (-inf: none)."""
    norms = lengths(vectors)
    best = Best(queries, query_ids, top.k, floor, float(norms.max(initial=0)) * float(lengths(queries).max(initial=0)) < EXACT)
    if not len(ids) or not len(query_ids):
        return best
    level = np.where(norms > 0, np.floor(np.log(np.maximum(norms, 1e-300)) / -math.log(top.ratio)), -np.inf)
    for of in np.unique(level)[::-1]:
        bucket = Bucket(vectors[level == of], ids[level == of])
        q = np.arange(len(query_ids))
        theta = best.theta(q)
        reach = best.norm * bucket.longest
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(reach > 0, theta / reach, np.where(theta > 0, np.inf, -np.inf))
            need = np.where(best.norm > 0, theta / best.norm, np.where(theta > 0, np.inf, 0.0))
        live = local <= 1 + SLACK
        wide = live & (local < top.coordinate_from)
        by_length(bucket, best, q[wide], need[wide], top.cells)
        close = live & ~wide
        if close.any():
            rest = by_coordinate(bucket, best, q[close], np.minimum(local[close], 1.0), top.focus, top.share)
            by_length(bucket, best, rest, need[rest], top.cells)
    return best


def prepare(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: TopK = TopK()) -> DataFrame:
    """``row, id, v, dim, norm, asks``: the vectors that take part, in whole numbers, stored; ``row`` tells repeated rows apart."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(F.coalesce(fine, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat = whole(lists.flatten().to_numpy(zero_copy_only=False).astype(float), top.scale)
            size = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(size)), size)
            most = np.ones(len(size))
            np.maximum.at(most, of, np.abs(flat))
            norm = most * np.sqrt(np.bincount(of, weights=(flat / most[of]) ** 2, minlength=len(size)))
            made = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("id"), made, batch.column("asks"), pa.array(size.astype(np.int32)), pa.array(norm)], names=["id", "v", "asks", "dim", "norm"])

    wide = rows.mapInArrow(run, "id bigint, v array<double>, asks boolean, dim int, norm double")
    return keep(wide.withColumn("row", F.monotonically_increasing_id()).withColumn("level", top.level(F.col("norm"))), "vectors")


def largest(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: TopK = TopK()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest products of each row that ``is_query`` holds for."""
    rows = prepare(df, is_query, key, vector, top)
    # one row for each number of components and level; levels are a fixed grid over the lengths that a double can have
    levels = rows.groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n")).withColumn("shards", F.expr(f"cast(ceil(n / {top.shard}) as int)"))
    levels = keep(levels, "levels")
    asked = keep(rows.filter("asks").select("dim", "norm", "id", "v").distinct(), "queries")
    blocks = asked.groupBy("dim").agg(F.expr(f"cast(ceil(count(1) / {top.block}) as int)").alias("blocks"))
    # the longest level that fills its results, else the fullest one
    filled = F.max(F.when(F.col("n") > top.k, F.col("level")))
    first = levels.groupBy("dim").agg(F.coalesce(filled, F.max_by("level", "n")).alias("start"))
    frame = keep(levels.join(first, "dim").join(blocks, "dim"), "frame")  # rows as levels
    asked = asked.withColumn("query", F.xxhash64("id", "v"))
    block = F.pmod(F.col("query"), F.col("blocks")).cast("int").alias("block")
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int").alias("shard")
    points = rows.join(frame, ["dim", "level"]).select("dim", "level", shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v", "start")
    points = points.select("dim", "level", "shard", "block", "id", "v", "start", F.lit(None).cast("double").alias("theta"), F.lit(False).alias("asks"))
    begin = (F.col("level") == F.col("start")) & (F.col("shard") == 0)
    fields = ["dim", "level", "shard", "block", "id", "v", "theta", "asks"]

    def work(part: pa.Table) -> pa.Table:
        asks = part.column("asks").to_numpy().astype(bool)
        ids = part.column("id").to_numpy()
        v = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        floor = part.column("theta").to_numpy()[asks].astype(float)
        best = search(v[~asks], ids[~asks], v[asks], ids[asks], np.where(np.isnan(floor), -np.inf, floor), top)
        q, at = np.nonzero(best.score > -np.inf)
        score = best.score[q, at]
        made = [pa.array(x) for x in (ids[asks][q], part.column("query").to_numpy()[asks][q], best.found[q, at])]
        return pa.Table.from_arrays([*made, pa.array([int(s) for s in score], pa.int64())], names=["query_id", "query", "vec_id", "score"])

    def met(some_points: DataFrame, some_queries: DataFrame, groups: int) -> DataFrame:
        both = some_points.withColumn("query", F.lit(0).cast("bigint")).select(*fields, "query").union(some_queries.select(*fields, "query"))
        dealt = both.repartition(max(1, groups), "dim", "level", "shard", "block").groupBy("dim", "level", "shard", "block")
        return keep(dealt.applyInArrow(work, "query_id bigint, query bigint, vec_id bigint, score bigint"), "found")

    # few rows, so each group may have a task of its own
    sizes = frame.agg(F.sum(F.when(F.col("level") == F.col("start"), F.col("blocks"))), F.sum(F.col("shards") * F.col("blocks"))).first()
    ones = frame.filter("level = start").select("dim", "level", "blocks")
    sent = asked.join(ones, "dim").select("dim", "level", F.lit(0).alias("shard"), block, "id", "v", F.lit(None).cast("double").alias("theta"), F.lit(True).alias("asks"), "query")
    found = met(points.filter(begin), sent, 2 * int(sizes[0] or 0))
    # the k-th product so far is the threshold everywhere else; as a double it may be rounded, so a little less
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    worst = found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == top.k).select(F.col("query_id").alias("id"), "query", (F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * SLACK).alias("theta"))
    known = asked.join(worst, ["id", "query"], "left")
    # the least level in which a vector can reach the threshold; one more for the rounding of logarithms
    need = F.when((F.col("theta") > 0) & (F.col("norm") > 0), top.level(F.col("theta") / F.col("norm")) - 1).when(F.col("theta") > 0, F.lit(1 << 20))
    others = known.withColumn("need", need).join(frame, "dim").filter("need is null or level >= need")
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).filter(~begin)
    sent = others.select("dim", "level", "shard", block, "id", "v", "theta", F.lit(True).alias("asks"), "query")
    found = found.union(met(points.filter(~begin), sent, 2 * int(sizes[1] or 0)))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top.k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: the same in SQL
TWIN = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(x * 256)) AS e, embedding AS given FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), fine AS (
  SELECT vec_id, e FROM v WHERE len(list_filter(given, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
