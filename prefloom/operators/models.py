"""Scorers, user functions and the two fitted models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import batches, text
from prefloom.session import keep


def score(df: DataFrame, column: str, factory: Callable[[], Callable[[list[str]], Sequence[float]]], batch: int = 32, out: str = "score"):
    """Score texts with a user model: the factory runs once per task, the model sees at most ``batch`` texts a call."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            parts = [list(model(texts.iloc[i : i + batch].tolist())) for i in range(0, len(texts), batch)]
            yield pd.Series([x for p in parts for x in p], dtype="float64")

    return df.withColumn(out, run(column))


def format_examples(df: DataFrame, fn: Callable[[pd.DataFrame], list[str]], key: str, key_type: str = "long", out: str = "text"):
    """Text per row from a user function over a batch of rows; it must return a list as long as the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = fn(b)
            if not isinstance(made, list) or len(made) != len(b):
                raise ValueError("the formatting function must return a list with one text per example")
            yield pd.DataFrame({key: b[key].to_numpy(), out: made})

    return df.mapInPandas(run, f"{key} {key_type}, {out} string")


def metric_agg(df: DataFrame, fn: Callable[[np.ndarray, np.ndarray], tuple[float, float]], prediction: str, label: str, by: Sequence[str] = ()):
    """User metric as a mean of parts: ``fn(predictions, labels)`` gives (sum, weight) for any slice of the rows.

    Slices are reduced inside the tasks, so a group is never gathered in one place.
    """
    keys = list(by)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            groups = b.groupby(keys, dropna=False) if keys else [((), b)]
            rows = [(*k, *fn(g[prediction].to_numpy(), g[label].to_numpy())) for k, g in groups]
            yield pd.DataFrame(rows, columns=[*keys, "_sum", "_weight"])

    parts = df.select(*keys, prediction, label).mapInPandas(partial, ", ".join(x for x in (fields, "_sum double, _weight double") if x))
    return parts.groupBy(*keys).agg(F.try_divide(F.sum("_sum"), F.sum("_weight")).alias("metric"))


FEATURES = 4096


def sparse_features(df: DataFrame, plus: Column, minus: Column | None = None, features: int = FEATURES) -> DataFrame:
    """``df`` with ``idx array<int>, val array<double>``: shares of the hashed tokens ``plus`` of a text, less those of ``minus``, sorted by feature.
    Arrays of token ids come in; the two sides are merged in their row, a bounded number of tokens at a time, and no row is made dense."""
    sides = [plus] if minus is None else [plus, minus]
    names = [f"_ids{k}" for k in range(len(sides))]
    rows = df.withColumns({n: F.transform(c, lambda x: x.cast("int")) for n, c in zip(names, sides, strict=True)})
    width = len(df.columns)

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(parts, names):
            made = _merged([batch.column(c) for c in names], features)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made.columns], names=[*batch.schema.names[:width], "idx", "val"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.select(*df.columns, *names).mapInArrow(merge, f"{fields}, idx array<int>, val array<double>")


def _merged(sides: Sequence[pa.Array], features: int) -> pa.RecordBatch:
    """``idx, val`` of the rows whose token ids are in ``sides``, the second of which counts against the first."""
    n = len(sides[0])
    keys, weights = [], []
    for k, lists in enumerate(sides):
        size = np.diff(lists.offsets.to_numpy())
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), size, 0)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(n), size)
        keys.append(of * features + ids % features)
        weights.append((1.0 - 2 * k) / np.repeat(np.maximum(size, 1), size))
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(at, weights=np.concatenate(weights), minlength=len(key))
    ends = np.concatenate(([0], np.cumsum(np.bincount(key // features, minlength=n)))).astype(np.int32)
    idx = pa.ListArray.from_arrays(pa.array(ends), pa.array((key % features).astype(np.int32)))
    val = pa.ListArray.from_arrays(pa.array(ends), pa.array(value))
    return pa.RecordBatch.from_arrays([idx, val], names=["idx", "val"])


def light(parts: Iterator[pa.RecordBatch], lists: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose ``lists`` hold a bounded number of elements."""
    for batch in parts:
        if batch.num_rows:
            for start, rows in batches.light(sum(batches.weights(batch.column(c)) for c in lists)):
                yield batch.slice(start, rows)


def _logits(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(logits rows x classes, row of each feature, features, values)."""
    lists = batch.column("idx")
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    idx, val = lists.flatten().to_numpy(), batch.column("val").flatten().to_numpy()
    out = np.stack([np.bincount(of, weights=val * w[idx], minlength=batch.num_rows) for w in weights], axis=1)
    return out, of, idx, val


def descend(rows: DataFrame, classes: int, features: int, steps: int, rate: float, reg: float) -> np.ndarray:
    """Weights (classes x features) of a softmax model on sparse ``rows`` (``idx, val, label``) by full gradient steps. With one class the label is not
    read: the model is the logistic one whose rows all are to score above zero.

    Each task adds its gradient up before anything is sent; per step, ``classes x features`` sums at most reach the driver and go out again with the
    next step, whatever the number of rows."""
    weights = np.zeros((classes, features))
    total = rows.count()
    for _ in range(steps if total else 0):

        def gradient(parts: Iterator[pa.RecordBatch], now: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            grad = np.zeros((classes, features))
            for batch in light(parts, ["idx"]):
                logits, of, idx, val = _logits(batch, now)
                if classes == 1:
                    pull = 1 / (1 + np.exp(logits))
                else:
                    p = np.exp(logits - logits.max(1, keepdims=True))
                    pull = (batch.column("label").to_numpy()[:, None] == np.arange(classes)) - p / p.sum(1, keepdims=True)
                for c in range(classes):
                    grad[c] += np.bincount(idx, weights=val * pull[of, c], minlength=features)
            at = np.flatnonzero(grad)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(grad.reshape(-1)[at])], names=["at", "g"])

        needed = rows.select("idx", "val") if classes == 1 else rows.select("idx", "val", "label")
        sums = needed.mapInArrow(gradient, "at bigint, g double").groupBy("at").agg(F.sum("g").alias("g")).collect()
        grad = np.zeros(classes * features)
        if sums:
            at, g = zip(*sums, strict=True)
            grad[list(at)] = g
        weights = weights + rate * (grad.reshape(classes, features) / total - reg * weights)
    return weights


def _scored(df: DataFrame, ids: Column, weights: np.ndarray, out: str, one: bool) -> DataFrame:
    rows = df.withColumn("_ids", F.transform(ids, lambda x: x.cast("int")))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in light(parts, ["_ids"]):
            logits = _logits(_merged([batch.column("_ids")], weights.shape[1]), weights)[0]
            result = pa.array(logits[:, 0]) if one else pa.array(logits.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], result], names=[*batch.schema.names[:-1], out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return rows.mapInArrow(work, f"{fields}, `{out}` {'double' if one else 'array<double>'}")


def ids_of(column: str) -> Column:
    return text.token_ids(text.tokens(column))


def fit_reward(pairs: DataFrame, chosen: str, rejected: str, features: int = FEATURES, steps: int = 8, rate: float = 400.0, reg: float = 0.0001) -> np.ndarray:
    """Linear Bradley–Terry model: the weights under which the token shares of chosen texts score above those of rejected ones."""
    rows = keep(sparse_features(pairs.select(chosen, rejected), ids_of(chosen), ids_of(rejected), features).select("idx", "val"), "pairs")
    return descend(rows, 1, features, steps, rate, reg)


def reward_score(df: DataFrame, model: np.ndarray, column: str, out: str = "score") -> DataFrame:
    """Linear score ``w·x`` of each text."""
    return _scored(df, ids_of(column), model, out, one=True)


def fit_segments(df: DataFrame, column: str, label: str, classes: int = 3, features: int = 1024, steps: int = 8, rate: float = 200.0, reg: float = 0.0001) -> np.ndarray:
    """Segment model on hashed tokens; ``label`` is 0 .. classes - 1."""
    rows = df.select(column, F.col(label).cast("bigint").alias("label")).filter("label is not null")
    return descend(keep(sparse_features(rows, ids_of(column), None, features).select("idx", "val", "label"), "segments"), classes, features, steps, rate, reg)


def segment_logits(df: DataFrame, model: np.ndarray, column: str, out: str = "logits") -> DataFrame:
    return _scored(df, ids_of(column), model, out, one=False)
