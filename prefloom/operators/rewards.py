"""Reward operators on tables: segment scatter, counts, rates, reports and the sample log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import rewards
from prefloom.functions.common import amean, asum


def fit_znorm(df: DataFrame, column: str, out: str, scale: float = 1.0, bias: float = 0.0) -> DataFrame:
    """z-normalise by the table's own mean and standard deviation (one aggregated row)."""
    fit = df.agg(F.struct(F.avg(column).alias("m"), F.stddev(column).alias("s"))).scalar()
    return df.withColumn(out, rewards.znorm(column, fit["m"], fit["s"], scale, bias))


def scatter_rewards(
    df: DataFrame, keys: Sequence[str], kinds: Sequence[str], positive: float = 1.0, negative: float = -1.0,
    sigmoid: bool = False, length: str = "length",
) -> DataFrame:
    """Token rewards per response from its segments, for several kinds in one grouping: ``keys, length`` and for each kind
    ``rewards_kind, n_segments, n_correct_kind``.

    Input: one row per segment with ``seg, end_pos, logits`` and the response's ``length``; ``seg`` null stands for
    a response without segments. Segments of a response are bounded by its length.
    """
    pos, neg = rewards.shape(F.lit(positive), sigmoid), rewards.shape(F.lit(negative), sigmoid)
    marks = [rewards.segment_correct(F.col("logits"), k).alias(k) for k in kinds]
    seg = F.when(F.col("seg").isNotNull(), F.struct("seg", "end_pos", *marks))
    grouped = df.groupBy(*keys, length).agg(F.collect_list(seg).alias("_segs"))
    inside = F.filter("_segs", lambda s: (s["end_pos"] >= 0) & (s["end_pos"] < F.col(length)))

    def usable(kind: str) -> Column:
        return F.transform(inside, lambda s: F.struct(s["seg"].alias("seg"), s["end_pos"].alias("end_pos"), s[kind].alias("correct")))

    def correct(kind: str) -> Column:
        return F.size(F.filter("_segs", lambda s: s[kind]))

    return grouped.select(
        *keys, length, F.size("_segs").alias("n_segments"),
        *[rewards.scatter(F.col(length), usable(k), pos, neg).alias(f"rewards_{k}") for k in kinds],
        *[correct(k).alias(f"n_correct_{k}") for k in kinds],
    )


def scatter_reward(df: DataFrame, keys: Sequence[str], kind: str, **options) -> DataFrame:
    """:func:`scatter_rewards` for one kind: ``keys, length, rewards, n_segments, n_correct``."""
    out = scatter_rewards(df, keys, [kind], **options)
    return out.withColumnsRenamed({f"rewards_{kind}": "rewards", f"n_correct_{kind}": "n_correct"})


def segment_counts(df: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("seg").alias("n_segments"),
        F.count_if(F.col("seg").isNotNull() & rewards.segment_correct(F.col("logits"), kind)).alias("n_correct"),
    )


def reward_report(df: DataFrame, metrics: Sequence[str], reward: str, how: str = "eval", by: Sequence[str] = ()) -> DataFrame:
    """Means of the metrics and of the reward: mean of sums for ``eval``, mean of means for ``test``."""
    per_row = {"eval": asum, "test": amean}[how](F.col(reward))
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.avg(per_row).alias("reward"))


def sample_log(df: DataFrame, query: str, response: str, reward: str) -> DataFrame:
    """``query, response, reward`` with the reward summed over its tokens."""
    return df.select(F.col(query).alias("query"), F.col(response).alias("response"), asum(F.col(reward)).alias("reward"))
