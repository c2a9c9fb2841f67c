"""Quality classifier: kernel ridge scores on document statistics, calibrated by isotonic regression.

Each text becomes a short vector of statistics (shares of signs, letters and digits, repetition of words and lines, lengths).
Random Fourier features of the standardised vector approximate a Gaussian kernel. Each partition sums its normal equations by
fold; the sums of all partitions, whose size depends on the number of features only, are added up by row of the matrix and solved on the
driver, once for all rows and once without each fold. The scores of left-out folds, counted in bins of fixed width, give
the isotonic calibration (pool adjacent violators), which is read off by interpolation, so that scores keep their order.

All labelled rows that are not held out take part; nothing is sampled. Cases: a null text counts as empty and is
scored as such; null labels and labels of unknown keys are passed over, repeated labels of a key are averaged; repeated rows are
scored each for itself; without any label all scores are 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import held_out, map_batches, text_of
from prefloom.session import keep

THRESHOLD = 0.3
HELD_OUT_FOLDS = 5
STATISTICS = (
    "log_words", "word_length", "upper", "digit", "space", "stop", "shout", "bar", "sign", "other",
    "distinct_words", "repeated_neighbours", "distinct_lines", "words_per_line", "high_bytes", "longest_word",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_OTHER = b"\"'()/:;<=>@[\\]^_`{}~+"


@dataclass(frozen=True)
class Setup:
    """Number of random features, ridge penalty per row, folds of the calibration, bins of the calibration and seed."""

    features: int = 192
    ridge: float = 1e-4
    folds: int = 4
    bins: int = 2048
    seed: int = 7


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray
    setup: Setup

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), 0.5)
        raw = features(x, self.mean, self.scale, self.setup) @ self.weights
        return np.interp(raw, self.knots, self.levels)


def statistics(text: str) -> list[float]:
    """The statistics of one text, in the order of ``STATISTICS``."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    size, n = max(len(data), 1), max(len(words), 1)
    count = lambda signs: len(data) - len(data.translate(None, signs))
    return [
        np.log1p(len(words)),
        np.log1p(len(data) / n),
        count(_UPPER) / size,
        count(_DIGIT) / size,
        count(b" \n\t\r") / size,
        np.log1p(count(b".,") / n),
        np.log1p(count(b"!?") / n),
        np.log1p(count(b"|") / n),
        np.log1p(count(b"*#$%&") / n),
        np.log1p(count(_OTHER) / n),
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(lines)) / max(len(lines), 1),
        np.log1p(len(words) / max(len(lines), 1)),
        count(_HIGH) / size,
        np.log1p(max(map(len, words), default=0)),
    ]


def measure(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, x array<double>`` for every row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in text_of(batch, text)], dtype=np.float64)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(STATISTICS)).cast(pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([batch.column(key), lists], names=[key, "x"])

    return map_batches(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, x array<double>")


def features(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, setup: Setup) -> np.ndarray:
    """Random Fourier features of a Gaussian kernel whose width is the root of the number of statistics, and a constant."""
    rng = np.random.default_rng(setup.seed)
    d = len(mean)
    w = rng.normal(size=(d, setup.features)) / np.sqrt(d)
    b = rng.uniform(0, 2 * np.pi, setup.features)
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([np.sqrt(2 / setup.features) * np.cos(z @ w + b), np.ones((len(x), 1))], axis=1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fit(measured: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", setup: Setup = Setup()) -> Model:
    """Learn from the rows of ``measured`` (key, x) that have a label and are not held out."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("y"))
    fold = (F.crc32(F.col(key).cast("string").cast("binary")) / HELD_OUT_FOLDS).cast("bigint") % setup.folds
    rows = measured.filter(~held_out(key, HELD_OUT_FOLDS)).join(known, key).select("x", "y", fold.cast("int").alias("fold"))
    rows = keep(rows, "labelled")
    d = len(STATISTICS)
    sums = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)]).first()
    if not sums["n"]:
        return Model(np.zeros(d), np.ones(d), np.zeros(1), np.zeros(0), np.zeros(0), setup)
    mean = np.array([sums[f"m{k}"] for k in range(d)])
    scale = np.array([sums[f"s{k}"] for k in range(d)])
    scale[scale < 1e-9] = 1.0
    size = setup.features + 1

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each fold and matrix row of this partition; the last column holds the right side."""
        total = np.zeros((setup.folds, size, size + 1))
        for batch in batches:
            if batch.num_rows:
                x, y, f = _matrix(batch), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                for k in range(setup.folds):
                    z = features(x[f == k], mean, scale, setup)
                    total[k] += z.T @ np.concatenate([z, y[f == k, None]], axis=1)
        flat = pa.FixedSizeListArray.from_arrays(pa.array(total.reshape(-1)), size + 1).cast(pa.list_(pa.float64()))
        at = np.arange(setup.folds * size)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), flat], names=["fold", "i", "v"])

    def add(part: pa.Table) -> pa.Table:
        v = part.column("v").combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1).sum(0)
        return pa.table({"fold": part.column("fold").slice(0, 1), "i": part.column("i").slice(0, 1), "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    shape = "fold int, i int, v array<double>"
    # folds x features rows of a fixed size reach the driver
    parts = rows.mapInArrow(normal, shape).groupBy("fold", "i").applyInArrow(add, shape).collect()
    eqs = np.zeros((setup.folds, size, size + 1))
    for p in parts:
        eqs[p["fold"], p["i"]] = p["v"]

    def solve(e: np.ndarray) -> np.ndarray:
        n = max(e[-1, -2], 1.0)
        return np.linalg.solve(e[:, :-1] + setup.ridge * n * np.eye(size), e[:, -1])

    whole = solve(eqs.sum(0))
    without = [solve(eqs.sum(0) - e) for e in eqs]

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Counts and label sums by score bin, the score being that of the model without the row's fold."""
        f, y = batch.column("fold").to_numpy(), batch.column("y").to_numpy()
        raw = (features(_matrix(batch), mean, scale, setup) * np.stack(without)[f]).sum(1)
        at = np.clip(np.floor((raw + 1) / 3 * setup.bins), 0, setup.bins - 1).astype(np.int64)
        n = np.bincount(at, minlength=setup.bins)
        got = np.flatnonzero(n)
        columns = [pa.array(got), pa.array(n[got].astype(np.float64)), pa.array(np.bincount(at, y, setup.bins)[got]), pa.array(np.bincount(at, raw, setup.bins)[got])]
        return pa.RecordBatch.from_arrays(columns, names=["bin", "n", "y", "raw"])

    bins = map_batches(rows, spread, "bin bigint, n double, y double, raw double").groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "y", "raw")])
    table = np.array(sorted((r["bin"], r["n"], r["y"], r["raw"]) for r in bins.collect()))
    knots, levels = isotonic(table[:, 3] / table[:, 1], table[:, 2] / table[:, 1], table[:, 1])
    return Model(mean, scale, whole, knots, levels, setup)


def isotonic(at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots are the weighted centres of the pools, so interpolation between them rises."""
    pools: list[list[float]] = []
    for a, v, w in sorted(zip(at.tolist(), y.tolist(), weight.tolist(), strict=True)):
        pools.append([a * w, v * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    knots = np.array([p[0] / p[2] for p in pools])
    levels = np.array([p[1] / p[2] for p in pools])
    return knots, np.clip(levels, 0.0, 1.0)


def score_measured(measured: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(model.score(_matrix(batch)))], names=[key, "score"])

    return map_batches(measured, work, f"`{key}` {measured.schema[key].dataType.simpleString()}, score double")


def accept(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text scores ``threshold`` or more, with their columns."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([statistics(t) for t in text_of(batch, text)], dtype=np.float64)
        return batch.filter(pa.array(model.score(x) >= threshold))

    return map_batches(df, work, df.schema)


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", setup: Setup = Setup()) -> DataFrame:
    """``key, held_out, score, predicted`` for every row."""
    measured = keep(measure(df, key, text), "statistics")
    model = fit(measured, labels, key, label, setup)
    scored = score_measured(measured, model, key)
    return scored.select(key, held_out(key, HELD_OUT_FOLDS).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


__all__ = ["Model", "Setup", "accept", "classify", "fit", "isotonic", "measure", "score_measured", "statistics"]
