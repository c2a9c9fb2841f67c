"""Buffers of a shard worked on in parts, and permutations that need no sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions.permute import permuted
from prefloom.operators import pairs, prep, rollout


def plain_buffers(rows, budget):
    out, number, held, last = [], 0, 0, None
    for shard, key, chars in sorted(rows):
        if shard != last:
            last, number, held = shard, 0, 0
        elif held >= budget:
            number, held = number + 1, 0
        out.append((shard, key, number))
        held += chars
    return out


@pytest.mark.parametrize(("seed", "rows", "budget"), [(0, 7, 50), (1, 40, 13.5), (2, 3, 400), (3, 1000, 90), (4, 11, 1)])
def test_buffers_equal_filling_row_by_row(spark, seed, rows, budget):
    rng = np.random.default_rng(seed)
    made = [(int(rng.choice([1, 1, 1, 2, 3])), k, int(rng.choice([0, 0, 1, 5, 30, 120]))) for k in range(400)]
    sizes = spark.createDataFrame([(s, k, c, 1) for s, k, c in made], "shard long, key long, chars long, n long")
    got = pairs.buffers_of(sizes, budget, rows).select("shard", "key", "buffer").collect()
    assert sorted(map(tuple, got)) == plain_buffers(made, budget)


def test_buffers_of_nothing(spark):
    assert pairs.buffers_of(spark.createDataFrame([], "shard long, key long, chars long, n long"), 9).collect() == []
    with pytest.raises(ValueError):
        pairs.buffers_of(spark.range(0), 0)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12, 101, 1000])
def test_permutations_are_permutations(spark, n):
    rows = spark.range(n).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in range(12)])))
    out = permuted(rows, "id", n, F.col("seed"), "y")
    assert out.columns == ["id", "seed", "y"]
    by_seed = {}
    for r in out.collect():
        by_seed.setdefault(r.seed, {})[r.id] = r.y
    assert all(sorted(p.values()) == list(range(n)) for p in by_seed.values())
    if n >= 101:
        orders = {tuple(p[k] for k in range(n)) for p in by_seed.values()}
        assert len(orders) == 12 and tuple(range(n)) not in orders
        # neighbours do not stay together, and places are spread over the whole
        p = np.array([by_seed[0][k] for k in range(n)])
        assert np.mean(np.abs(np.diff(p)) <= 3) < 0.15 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.3


def test_epochs_need_no_exchange(spark):
    rows = spark.range(500).withColumnRenamed("id", "place")
    out = rollout.minibatches(rows, "place", 500, 4, 32, 16)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    epochs = {}
    for r in out.collect():
        epochs.setdefault(r.epoch, []).append((r.position, r.backward_batch, r.mini_batch))
    assert len(epochs) == 4 and all(sorted(e) == [(k, k // 32, k % 32 // 16) for k in range(500)] for e in epochs.values())


def test_places_split_exactly(spark):
    out = prep.split_places(spark.range(103), "id", 103).groupBy("part").count().collect()
    test = math.ceil(103 * 0.3)
    assert dict(map(tuple, out)) == {"test": test, "eval": math.ceil((103 - test) * 0.1), "train": 103 - test - math.ceil((103 - test) * 0.1)}


def test_quantile_sketches_keep_their_rank_error(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=20_000), rng.exponential(size=20_000) * 50, np.full(5_000, 3.0)])
    df = spark.createDataFrame([(k % 3, float(v)) for k, v in enumerate(x)], "g int, x double").repartition(16)
    shares = [0.01, 0.5, 0.9]
    for accuracy in (50, 1000):
        for r in rollout.quantiles(df, {"x": F.col("x")}, shares, ["g"], accuracy).collect():
            v = np.sort(x[r.g :: 3])
            low, high = np.searchsorted(v, r.quantile, "left"), np.searchsorted(v, r.quantile, "right")
            assert low - len(v) / accuracy - 1 <= r.share * len(v) <= high + len(v) / accuracy + 1
    small = rollout.quantiles(df.limit(900), {"x": F.col("x"), "y": -F.col("x")}, shares, [], 1000)
    assert {(r.value, r.share) for r in small.collect()} == {(v, s) for v in "xy" for s in shares}


def test_descent_equals_a_plain_fit(spark):
    from prefloom.functions import text
    from prefloom.operators import models

    rng = np.random.default_rng(2)
    words = [["good", "fine", "b", "c"], ["bad", "poor", "b", "c"], ["odd", "b", "c", "d"]]
    rows = [(k, " ".join(rng.choice(words[k % 3], rng.integers(0, 12))), k % 3) for k in range(90)]
    df = spark.createDataFrame(rows, "k int, t string, label int")
    model = models.fit_segments(df, "t", "label", features=64, steps=5, rate=20.0)
    ids = {r.k: r.i for r in df.select("k", text.token_ids(text.tokens("t")).alias("i")).collect()}
    x = np.zeros((90, 64))
    for k, some in ids.items():
        for i in some:
            x[k, i % 64] += 1 / len(some)
    w, y = np.zeros((3, 64)), np.eye(3)[[r[2] for r in rows]]
    for _ in range(5):
        e = np.exp(x @ w.T)
        w = w + 20.0 * ((y - e / e.sum(1, keepdims=True)).T @ x / 90 - 0.0001 * w)
    assert np.allclose(model, w) and np.abs(w).max() > 0.1
    got = {r.k: r.logits for r in models.segment_logits(df, model, "t").collect()}
    assert np.allclose([got[k] for k in range(90)], x @ w.T)
    assert (np.argmax(x @ w.T, 1) == [r[2] for r in rows]).mean() > 0.8
    assert not models.fit_segments(df.limit(0), "t", "label", features=8).any()


def test_kept_tables_go_at_the_end_of_their_query(spark):
    from prefloom import session

    outer = session.keep(spark.range(3), "outer")
    with session.tidy():
        inner = session.keep(spark.range(4), "inner")
        assert inner.count() == 4
    assert outer.count() == 3
    path = inner.inputFiles()[0].rsplit("/", 1)[0]
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
