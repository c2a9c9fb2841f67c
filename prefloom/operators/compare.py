"""Comparison of runs: summaries, win counts, inconsistency, judged outcomes.

A run is a set of rows ``(run, idx, generation, metric columns)``; rows of different runs belong together when
they have the same ``idx``. The number of runs is small (it is the number of files compared), the number of rows
is not: rows are gathered once per ``idx`` and pairs are counted inside the task, so the shuffle carries every row
once however many runs there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions.common import hash_order
from prefloom.session import keep

# Metrics for which less is better when they are held against the holistic score.
LOWER_IS_BETTER = ("error_rate", "grammar_errors")


def metric_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean, true minimum and true maximum of each metric per run, in long form."""
    aggs = [
        F.struct(
            F.lit(m).alias("metric"),
            F.avg(F.col(m).cast("double")).alias("mean"),
            F.min(F.col(m).cast("double")).alias("min"),
            F.max(F.col(m).cast("double")).alias("max"),
        )
        for m in metrics
    ]
    return df.groupBy("run").agg(F.array(*aggs).alias("m")).select("run", F.inline("m"))


def dedup_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row per ``key``, sorted by it. Each task keeps one row per key before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").orderBy(key)


def union_runs(*dfs: DataFrame) -> DataFrame:
    """All rows of all record lists, repeats included."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def run_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs of different runs per ``idx``: ``idx, run_a, run_b, <c>_a, <c>_b``.

    The output is (number of runs − 1) times the input by definition; reports that only count use
    :func:`win_counts`, which never shuffles these rows.
    """
    side = {s: df.select("idx", F.col("run").alias(f"run_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in columns])
            for s in "ab"}
    return side["a"].join(side["b"], "idx").filter("run_a <> run_b")


def _paired_metrics(df: DataFrame, metrics: Sequence[str], holistic: str | None) -> DataFrame:
    """``run_a, run_b, metric, va, vb[, ha, hb]`` generated from one row per ``idx``."""
    row = F.struct("run", *[F.col(m).cast("double").alias(m) for m in dict.fromkeys([*metrics, *([holistic] if holistic else [])])])
    aligned = df.groupBy("idx").agg(F.collect_list(row).alias("rows"))
    pairs = aligned.select("rows", F.explode("rows").alias("a")).select("a", F.explode("rows").alias("b"))
    pairs = pairs.filter(F.col("a.run") != F.col("b.run"))
    extra = [F.col(f"a.{holistic}").alias("ha"), F.col(f"b.{holistic}").alias("hb")] if holistic else []
    values = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("va"), F.col(f"b.{m}").alias("vb")) for m in metrics]
    )
    return pairs.select(
        F.col("a.run").alias("run_a"), F.col("b.run").alias("run_b"), *extra, F.inline(values)
    )


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def win_counts(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows won, tied and lost by run a against run b, per metric, by the raw value."""
    p = _paired_metrics(df, metrics, None)
    return p.groupBy("run_a", "run_b", "metric").agg(
        _count(F.col("va") > F.col("vb")).alias("win"),
        _count(F.col("va") == F.col("vb")).alias("tie"),
        _count(F.col("va") < F.col("vb")).alias("lose"),
    )


def win_rate(counts: DataFrame) -> DataFrame:
    """``100·win/(win+lose)``; 50 when no row is decided."""
    decided = F.col("win") + F.col("lose")
    return counts.withColumn("win_rate", F.when(decided > 0, F.col("win") * 100 / decided).otherwise(F.lit(50.0)))


def inconsistency(df: DataFrame, metrics: Sequence[str], holistic: str = "holistic_reward") -> DataFrame:
    """Share of holistically decided rows whose metric verdict is decided and opposite."""
    p = _paired_metrics(df, metrics, holistic)
    sign = F.signum(F.col("va") - F.col("vb"))
    sign = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -sign).otherwise(sign)
    overall = F.signum(F.col("ha") - F.col("hb"))
    out = p.groupBy("run_a", "run_b", "metric").agg(
        _count(overall * sign < 0).alias("opposite"), _count(overall != 0).alias("decided")
    )
    rate = F.when(F.col("decided") > 0, F.col("opposite") * 100 / F.col("decided")).otherwise(F.lit(0.0))
    return out.withColumn("holistic_reward_inconsistent", rate)


def avg_win_rate(rates: DataFrame) -> DataFrame:
    """Mean win rate of each run against all others, per metric."""
    return rates.groupBy("run_a", "metric").agg(F.avg("win_rate").alias("avg_win_rate"))


def win_matrix(rates: DataFrame, metric: str) -> DataFrame:
    """Win rates as text, run a by run b, ``*`` on the diagonal, and an ``Avg.`` column. Every run of the table gets its column."""
    one = keep(rates.filter(F.col("metric") == metric), "rates")
    runs = sorted(r["run_a"] for r in one.select("run_a").distinct().collect())
    cells = [
        F.when(F.col("run_a") == r, F.lit("*"))
        .otherwise(F.format_string("%.2f", F.max(F.when(F.col("run_b") == r, F.col("win_rate")))))
        .alias(r)
        for r in runs
    ]
    return one.groupBy("run_a").agg(*cells, F.format_string("%.2f", F.avg("win_rate")).alias("Avg."))


def trivial_ties(pairs: DataFrame) -> DataFrame:
    """Pairs with identical output: ties without a judge. Needs ``generation_a, generation_b``."""
    return pairs.filter(F.col("generation_a") == F.col("generation_b"))


def judged_counts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcome per ordered pair of runs from verdicts in both orders.

    A row is decided when verdict(a,b) and verdict(b,a) are both there and differ; anything else is a tie.
    Both orders of a pair of runs meet in one group per row; no join is needed.
    """
    first = F.least("run_a", "run_b")

    def side(df: DataFrame, verdict: Column, pair: bool) -> DataFrame:
        return df.select(
            "idx", first.alias("lo"), F.greatest("run_a", "run_b").alias("hi"), (F.col("run_a") == first).alias("fwd"),
            verdict.cast("int").alias("verdict"), F.lit(pair).alias("pair"),
        )

    both = side(pairs, F.lit(None), True).union(side(verdicts, F.col("verdict"), False))
    at = lambda fwd, x: F.max(F.when(F.col("fwd") == fwd, x))
    met = both.groupBy("idx", "lo", "hi").agg(
        *[at(f, F.col("verdict")).alias(f"v{int(f)}") for f in (True, False)], *[at(f, F.col("pair")).alias(f"p{int(f)}") for f in (True, False)]
    )

    def seen(a: str, b: str, fwd: int) -> Column:
        return F.struct(
            F.col(a).alias("run_a"), F.col(b).alias("run_b"), F.col(f"p{fwd}").alias("pair"),
            F.col(f"v{fwd}").alias("forward"), F.col(f"v{1 - fwd}").alias("swapped"),
        )

    j = met.select(F.inline(F.array(seen("lo", "hi", 1), seen("hi", "lo", 0)))).filter("pair")
    decided = F.col("forward") != F.col("swapped")
    return j.groupBy("run_a", "run_b").agg(
        _count(decided & (F.col("forward") == 1)).alias("win"),
        _count(~F.coalesce(decided, F.lit(False))).alias("tie"),
        _count(decided & (F.col("forward") == 0)).alias("lose"),
    )


def shared_sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The same ``n`` positions of every run, drawn by hash order from the positions all runs have.

    The drawn list is kept, so the planner knows its size and broadcasts it below its threshold.
    """
    n_runs = df.agg(F.count_distinct("run")).scalar()
    common = df.groupBy("idx").agg(F.count_distinct("run").alias("k")).filter(F.col("k") == n_runs)
    drawn = keep(common.orderBy(hash_order("idx", seed), "idx").limit(n).select("idx"), "drawn")
    return df.join(drawn, "idx", "left_semi")

