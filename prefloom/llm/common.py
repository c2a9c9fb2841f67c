"""What several operators of this package share: reading tables, walking Arrow batches, components of a graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.session import keep, spread


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table; with a key it is dealt out when it comes in a few files only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if key is None else spread(df, key)


def text_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[str]:
    """The texts of a batch, a null being an empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """Apply ``work`` to each Arrow batch; batches without rows are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def held_out(key: Column | str, folds: int) -> Column:
    """True where crc32 of the key as text leaves no remainder; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def local_roots(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member index of each component of the graph over 0..n-1 with edges (a, b), vectorised hooking and
    pointer jumping. ``label`` holds roots found before."""
    root = np.arange(n) if label is None else label.copy()
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            break
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` for every id that ``edges(a, b)`` names: root is the smallest id that it reaches.

    Large-star and small-star steps in turn until the edges stay as they are: a number of rounds in the logarithm
    of the longest chain. A step takes the smallest neighbour by a map-side aggregate and joins it back, so a
    centre with very many neighbours is a skewed join side, which adaptive execution splits. Each round is written to
    the shared folder, so lineage stays short and a lost executor costs one round at most."""

    def nearest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = nearest(both).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v")
        least = nearest(down)
        moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b")

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        now = keep(small(large(now).distinct()).distinct(), "edges")
        last, seen = seen, mark(now)
        if last == seen:
            break
    leaves = now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root"))
    return leaves.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def pieces(values: Iterable, size: int) -> Iterator[list]:
    values = list(values)
    for k in range(0, len(values), size):
        yield values[k : k + size]
