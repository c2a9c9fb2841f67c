"""Rollout statistics: advantages, whitening, losses, step and batch statistics.

A rollout is one row per sequence with ``array<double>`` columns. Per-sequence work stays inside the row; batch
statistics explode tokens inside the task and aggregate them map-side, so only partial sums are shuffled. Batch
values return to the rows through a join on the aggregated table, never through a window over the batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from prefloom.functions import stats
from prefloom.functions.common import amean, asum, ratio
from prefloom.functions.permute import permuted
from prefloom.operators.ordering import running
from prefloom.session import keep

EPS = 1e-8  # fixed value: added to the variance before the square root


def advantages(df: DataFrame, beta: float = 0.2, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Adds ``rewards``, ``advantages`` (raw) and ``returns`` to rollouts."""
    c = F.col
    return (
        df.withColumn("rewards", stats.token_rewards(c("logprobs"), c("ref_logprobs"), c("scores"), beta))
        .withColumn("advantages", stats.gae(c("rewards"), c("values"), c("mask"), gamma, lam))
        .withColumn("returns", stats.returns(c("advantages"), c("values"), c("mask")))
    )


def explode_tokens(df: DataFrame, keys: Sequence[str], arrays: Sequence[str]) -> DataFrame:
    """One row per token: keys, ``pos`` and the elements of the arrays."""
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return df.select(*keys, F.posexplode(zipped).alias("pos", "_t")).select(*keys, "pos", "_t.*")


def masked_mean(df: DataFrame, value: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of a long-form value over mask 1; null where the mask is empty."""
    return df.groupBy(*by).agg(ratio(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("mean"))


def masked_means(df: DataFrame, value: str, mask: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    """:func:`masked_mean` for several groupings in one aggregate: the grouping columns (null where not grouped), ``by`` and ``mean``."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *columns)
    by = F.concat_ws(",", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns])
    return grouped.agg(by.alias("by"), ratio(F.sum(F.col(value) * F.col(mask)), F.sum(mask)).alias("mean"))


def _var(x: Column, m: Column, unbiased: bool = True) -> Column:
    kept = F.when(m == 1, x)
    n = F.count(kept)
    return F.try_divide(F.var_pop(kept) * n, (n - 1).cast("double")) if unbiased else F.var_pop(kept)


def masked_var(df: DataFrame, value: str, mask: str, by: Sequence[str] = ()) -> DataFrame:
    """Variance over mask 1 about the masked mean: ``var`` with the n/(n−1) correction, null for fewer than two tokens, and ``biased``
    without."""
    both = [_var(F.col(value), F.col(mask), unbiased).alias(name) for name, unbiased in (("var", True), ("biased", False))]
    return df.groupBy(*by).agg(*both)


def whiten(df: DataFrame, value: str, by: Sequence[str] = (), mask: str | None = None, shift: bool = True, out: str = "whitened"):
    """``(x − mean)/sqrt(var + 1e-8)`` of a long-form value; statistics over all rows or per group, optionally masked."""
    m = F.col(mask) if mask else F.lit(1)
    mean = F.avg(F.when(m == 1, F.col(value)))
    var = _var(F.col(value), m)
    if by:
        both = df.join(df.groupBy(*by).agg(mean.alias("_m"), var.alias("_v")), list(by))
        mu, v = F.col("_m"), F.col("_v")
    else:
        fit = df.agg(F.struct(mean.alias("m"), var.alias("v"))).scalar()
        both, mu, v = df, fit["m"], fit["v"]
    white = (F.col(value) - mu) / F.sqrt(v + EPS)
    return both.withColumn(out, white if shift else white + mu).drop("_m", "_v")


def whiten_arrays(df: DataFrame, column: str, mask: str, by: Sequence[str], out: str) -> DataFrame:
    """Masked whitening of an array column by batch; the arrays stay in their rows.

    The sequences are gathered once and kept, so give no more columns than are needed. The batches' own rows are kept as well, so the planner knows their size: they are broadcast while they are
    below its threshold and meet the sequences in a shuffle beyond it."""
    df = keep(df, "sequences")
    tok = explode_tokens(df, by, [column, mask])
    fit = tok.groupBy(*by).agg(
        F.avg(F.when(F.col(mask) == 1, F.col(column))).alias("_m"), _var(F.col(column), F.col(mask)).alias("_v")
    )
    joined = df.join(keep(fit, "batches"), list(by))
    return joined.withColumn(out, F.transform(column, lambda x: (x - F.col("_m")) / F.sqrt(F.col("_v") + EPS))).drop("_m", "_v")


def train_stats(
    df: DataFrame, by: Sequence[str] = ("batch",), cliprange: float = 0.2, cliprange_value: float = 0.2,
    vf_coef: float = 0.1, ratio_threshold: float = 10.0,
) -> DataFrame:
    """Losses and statistics per batch from long-form tokens, in one aggregate.

    Needs ``lp, old_lp, value, vpred, adv, ret, mask`` and optionally ``entropy``. A mean ratio above
    ``ratio_threshold`` sets the three losses of the batch to zero.
    """
    c = F.col
    v_clip = stats.clip(c("vpred"), c("value") - cliprange_value, c("value") + cliprange_value)
    e1, e2 = (c("vpred") - c("ret")) ** 2, (v_clip - c("ret")) ** 2
    r = F.exp(c("lp") - c("old_lp"))
    p1 = -c("adv") * r
    p2 = -c("adv") * stats.clip(r, F.lit(1.0 - cliprange), F.lit(1.0 + cliprange))

    def mean(x: Column) -> Column:
        return F.avg(F.when(c("mask") == 1, x))

    extra = [mean(c("entropy")).alias("policy/entropy")] if "entropy" in df.columns else []
    out = df.groupBy(*by).agg(
        mean(F.greatest(p1, p2)).alias("loss/policy"),
        (mean(F.greatest(e1, e2)) * 0.5).alias("loss/value"),
        mean((c("lp") - c("old_lp")) ** 2 * 0.5).alias("policy/approxkl"),
        mean(c("old_lp") - c("lp")).alias("policy/policykl"),
        mean((p2 > p1).cast("double")).alias("policy/clipfrac"),
        mean(c("adv")).alias("policy/advantages_mean"),
        mean(r).alias("policy/ratio_mean"),
        mean(c("ret")).alias("returns/mean"),
        _var(c("ret"), c("mask")).alias("returns/var"),
        mean(c("vpred")).alias("val/vpred"),
        mean(e1).alias("val/error"),
        mean((e2 > e1).cast("double")).alias("val/clipfrac"),
        mean(c("value")).alias("val/mean"),
        _var(c("value"), c("mask")).alias("val/var"),
        *extra,
    )
    out = out.withColumn("loss/total", c("loss/policy") + c("loss/value") * vf_coef)
    for name in ("loss/policy", "loss/value", "loss/total"):
        out = out.withColumn(name, F.when(c("policy/ratio_mean") > ratio_threshold, F.lit(0.0)).otherwise(c(name)))
    return out.withColumn("val/var_explained", F.lit(1.0) - F.try_divide(c("val/error"), c("returns/var")))


def step_stats(df: DataFrame, by: Sequence[str] = ("batch",), beta: float = 0.2) -> DataFrame:
    """Objective statistics per step from rollouts: KL, entropy, non-score reward, score mean and deviation."""
    c = F.col
    diff = F.zip_with("logprobs", "ref_logprobs", lambda a, b: a - b)
    per_seq = df.select(
        *by,
        asum(stats.masked(diff, c("mask"))).alias("kl"),
        asum(stats.masked(F.transform("logprobs", lambda x: -x), c("mask"))).alias("entropy"),
        F.aggregate("mask", F.lit(0), lambda s, m: s + m).alias("n"),
        amean(c("scores")).alias("score"),
    )
    return per_seq.groupBy(*by).agg(
        F.avg("kl").alias("objective/kl"), F.avg("entropy").alias("objective/entropy"),
        ratio(F.sum(c("kl")) * -beta, F.sum("n")).alias("ppo/mean_non_score_reward"),
        F.avg("score").alias("ppo/mean_scores"), F.stddev_samp("score").alias("ppo/std_scores"),
    )


def length_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and standard deviation of array lengths."""
    aggs = [f(F.size(c).cast("double")).alias(f"{c}_len_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*by).agg(*aggs)


def length_dist(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.size(column).cast("bigint").alias("length")).count()


def env_rewards(df: DataFrame, reward: str, keys: Sequence[str]) -> DataFrame:
    """The reward of each sequence, one row each: what a histogram of rewards is drawn from."""
    return df.select(*keys, asum(F.col(reward)).alias("reward"))


def quantiles(df: DataFrame, values: dict[str, Column], shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000) -> DataFrame:
    """Quantiles of several values per group, one row each: ``by…, value, share, quantile``, the least value that ``share`` of the rows do not exceed.

    Each task sends a sketch of at most about ``accuracy`` values per group, and sketches are merged, so neither a group's rows nor its distinct values are gathered. The rank of a
    given quantile is off by ``n / accuracy`` rows at most; groups of fewer rows than ``accuracy`` are exact."""
    p = F.array(*[F.lit(float(s)) for s in shares])
    sketched = df.groupBy(*by).agg(*[F.percentile_approx(v, p, accuracy).alias(n) for n, v in values.items()])
    each = [F.struct(F.lit(n).alias("value"), F.transform(F.arrays_zip(p.alias("share"), F.col(n).alias("quantile")), lambda q: F.struct(q["share"].alias("share"), q["quantile"].cast("double").alias("quantile"))).alias("q")) for n in values]
    rows = sketched.select(*by, F.explode(F.array(*each)).alias("v"))
    return rows.select(*by, "v.value", F.explode("v.q").alias("q")).select(*by, "value", "q.share", "q.quantile")


def sequence_kl(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The masked KL sum of each sequence, one row each."""
    diff = F.zip_with("logprobs", "ref_logprobs", lambda a, b: a - b)
    return df.select(*keys, asum(stats.masked(diff, F.col("mask"))).alias("kl"))


def env_reward_stats(df: DataFrame, reward: str, by: Sequence[str]) -> DataFrame:
    return env_rewards(df, reward, by).groupBy(*by).agg(F.avg("reward").alias("env/reward_mean"), F.stddev_samp("reward").alias("env/reward_std"))


def kl_coef(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = ("run",), init: float = 0.2,
    target: float = 6.0, horizon: float = 10_000, kl: str = "kl", n_steps: str = "n_steps", adaptive: bool = True,
) -> DataFrame:
    """Coefficient after each logged step: ``init`` times the running product of the bounded corrections.

    The product is a running sum of logarithms, so it needs ``0.2 · n_steps < horizon``; a row that breaks this
    raises an error.
    """
    if not adaptive:
        return df.withColumn("kl_coef", F.lit(init))
    error = stats.clip(F.col(kl) / target - 1, F.lit(-0.2), F.lit(0.2))
    mult = F.lit(1.0) + error * F.col(n_steps) / horizon
    checked = F.when(mult > 0, F.ln(mult)).otherwise(F.raise_error(F.lit("kl_coef: n_steps is too large for the horizon")))
    out = running(df, checked, "_log", order, by)
    return out.withColumn("kl_coef", F.exp("_log") * init).drop("_log")


def early_stop(df: DataFrame, target: float, step: Sequence[str] = ("step",)) -> DataFrame:
    """Keep the epochs of a step up to the first whose last mini batch exceeds ``1.5 · target`` in mean policy KL.

    Input: one row per ``step…, epoch, mini_batch, worker`` with ``policykl``.
    """
    last = df.groupBy(*step, "epoch").agg(F.max("mini_batch").alias("mini_batch"))
    over = (
        df.join(last, [*step, "epoch", "mini_batch"])
        .groupBy(*step, "epoch").agg((F.avg("policykl") > 1.5 * target).alias("over"))
    )
    first = over.filter("over").groupBy(*step).agg(F.min("epoch").alias("_stop"))
    return df.join(first, list(step), "left").filter(F.col("_stop").isNull() | (F.col("epoch") <= F.col("_stop"))).drop("_stop")


def best_so_far(df: DataFrame, value: str, order: Sequence[str], by: Sequence[str], step: str, every: int):
    """Rows compared (every ``every`` steps) with the best value so far and whether the row improves on it."""
    compared = df.filter(F.col(step) % every == 0)
    out = running(compared, F.col(value), "_prev", order, by, "max", inclusive=False)
    return out.withColumn("best", F.greatest("_prev", value)).withColumn(
        "improved", F.col("_prev").isNull() | (F.col(value) > F.col("_prev"))
    ).drop("_prev")


def minibatches(df: DataFrame, place: str, n: int, epochs: int, backward: int, mini: int, seed: int = 42) -> DataFrame:
    """Seeded permutation per epoch: ``epoch, position, backward_batch, mini_batch``. ``place`` numbers the ``n`` rows from 0; each epoch's position
    follows from it without a sort or a shuffle."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    out = permuted(rows, place, n, F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string")), "position")
    return out.withColumn("backward_batch", F.floor(F.col("position") / backward)).withColumn(
        "mini_batch", F.floor((F.col("position") % backward) / mini)
    )


def array_mean(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Element-wise mean of arrays, as one array per group."""
    per_pos = df.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("x"))
    gathered = per_pos.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_s"))
    return gathered.select(*by, F.transform("_s", lambda s: s["x"]).alias(column))


def stack_ragged(df: DataFrame, column: str, pad: float = -1.0) -> DataFrame:
    """Pad arrays to the longest of the table; NaN becomes the pad value."""
    n = df.agg(F.max(F.size(column))).scalar()
    clean = F.transform(column, lambda x: F.nanvl(x, F.lit(pad)))
    return df.withColumn(column, F.concat(clean, F.array_repeat(F.lit(pad), n - F.size(column))))


def flatten_struct(df: DataFrame, sep: str = "/", suffix: str = "") -> DataFrame:
    """Nested structs as columns named by path; arrays of one element become scalars at run time via element 1."""

    def walk(schema: StructType, path: tuple[str, ...]):
        for f in schema.fields:
            if sep in f.name:
                raise ValueError(f"separator {sep!r} is not allowed in key {f.name!r}")
            at = (*path, f.name)
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, at)
            else:
                yield at, f.dataType

    def leaf(at: tuple[str, ...]) -> Column:
        return F.col(".".join(f"`{p}`" for p in at)).alias(sep.join(at) + suffix)

    return df.select(*[leaf(at) for at, _ in walk(df.schema, ())])


def single_to_scalar(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Arrays that hold exactly one element become that element; longer ones become null."""
    for c in columns:
        if isinstance(df.schema[c].dataType, ArrayType):
            df = df.withColumn(c, F.when(F.size(c) == 1, F.get(c, F.lit(0))))
    return df


def worker_mean(df: DataFrame, columns: Sequence[str], worker: str, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of per-worker means."""
    per = df.groupBy(*by, worker).agg(*[F.avg(c).alias(c) for c in columns])
    return per.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def step_train_stats(stats_df: DataFrame, step: str) -> DataFrame:
    """Mean of every mini-batch statistic per step, with the ``ppo/`` prefix."""
    skip = {step, "mini_batch", "batch"}
    return stats_df.groupBy(step).agg(*[F.avg(f"`{c}`").alias(f"ppo/{c}") for c in stats_df.columns if c not in skip])

