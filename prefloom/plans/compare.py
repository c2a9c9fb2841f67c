"""Registered run comparison queries."""

from __future__ import annotations

from prefloom.functions.common import r6
from prefloom.operators import compare as cmp
from prefloom.plans.registry import query
from prefloom.plans.tables import LONG_RUNS, METRICS, RUNS, runs

PAIRS = """pairs AS (SELECT a.run AS run_a, b.run AS run_b, a.metric, a.v AS va, b.v AS vb, a.h AS ha, b.h AS hb
  FROM long_runs a JOIN long_runs b ON a.idx = b.idx AND a.metric = b.metric AND a.run <> b.run)"""
COUNTS = """counts AS (SELECT run_a, run_b, metric, count(*) FILTER (va > vb) AS win, count(*) FILTER (va = vb) AS tie,
  count(*) FILTER (va < vb) AS lose FROM pairs GROUP BY ALL)"""
RATES = "rates AS (SELECT *, CASE WHEN win + lose > 0 THEN 100.0::DOUBLE * win / (win + lose) ELSE 50.0::DOUBLE END AS win_rate FROM counts)"
BASE = f"WITH {RUNS}, {LONG_RUNS}, {PAIRS}, {COUNTS}, {RATES}"


@query("e1_metric_summary", f"""WITH {RUNS}, {LONG_RUNS} SELECT run, metric, round(avg(v), 6) AS mean, round(min(v), 6) AS min,
  round(max(v), 6) AS max FROM long_runs GROUP BY ALL""")
def e1(spark, sf):
    out = cmp.metric_summary(runs(spark, sf), METRICS)
    return out.select("run", "metric", r6("mean").alias("mean"), r6("min").alias("min"), r6("max").alias("max"))


@query("e2_dedup_first", f"""WITH {RUNS} SELECT doc_id, run, idx, query FROM runs
  QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) = 1 ORDER BY query""")
def e2(spark, sf):
    return cmp.dedup_first(runs(spark, sf).select("doc_id", "run", "idx", "query"), "query", ["doc_id"])


@query("e3_run_pairs", f"""WITH {RUNS} SELECT a.idx, a.run AS run_a, b.run AS run_b, round(a.readability, 6) AS readability_a,
  round(b.readability, 6) AS readability_b FROM runs a JOIN runs b ON a.idx = b.idx AND a.run <> b.run""")
def e3(spark, sf):
    p = cmp.run_pairs(runs(spark, sf), ["readability"])
    return p.select("idx", "run_a", "run_b", r6("readability_a").alias("readability_a"), r6("readability_b").alias("readability_b"))


@query("e4_win_counts", f"{BASE} SELECT * FROM counts")
def e4(spark, sf):
    return cmp.win_counts(runs(spark, sf), METRICS)


@query("e5_win_rate", f"{BASE} SELECT run_a, run_b, metric, round(win_rate, 6) AS win_rate FROM rates")
def e5(spark, sf):
    out = cmp.win_rate(cmp.win_counts(runs(spark, sf), METRICS))
    return out.select("run_a", "run_b", "metric", r6("win_rate").alias("win_rate"))


@query("e6_inconsistency", f"""WITH {RUNS}, {LONG_RUNS}, {PAIRS}, signs AS (SELECT run_a, run_b, metric, sign(ha - hb) AS o,
  CASE WHEN metric IN ('error_rate', 'grammar_errors') THEN -1 ELSE 1 END * sign(va - vb) AS m FROM pairs)
  SELECT run_a, run_b, metric, count(*) FILTER (o * m < 0) AS opposite, count(*) FILTER (o <> 0) AS decided,
  round(CASE WHEN count(*) FILTER (o <> 0) > 0 THEN 100.0::DOUBLE * count(*) FILTER (o * m < 0) / count(*) FILTER (o <> 0)
  ELSE 0.0::DOUBLE END, 6) AS holistic_reward_inconsistent FROM signs GROUP BY ALL""")
def e6(spark, sf):
    out = cmp.inconsistency(runs(spark, sf), METRICS)
    return out.withColumn("holistic_reward_inconsistent", r6("holistic_reward_inconsistent"))


@query("e7_avg_win_rate", f"{BASE} SELECT run_a, metric, round(avg(win_rate), 6) AS avg_win_rate FROM rates GROUP BY ALL")
def e7(spark, sf):
    out = cmp.avg_win_rate(cmp.win_rate(cmp.win_counts(runs(spark, sf), METRICS)))
    return out.select("run_a", "metric", r6("avg_win_rate").alias("avg_win_rate"))


MATRIX_RUNS = [f"src{i}" for i in range(20)]  # the runs of the given tables, for the SQL twin alone


@query("e8_win_matrix", f"""{BASE} SELECT run_a, {', '.join(
    f"CASE WHEN run_a = '{r}' THEN '*' ELSE format('{{:.2f}}', max(win_rate) FILTER (run_b = '{r}')) END AS {r}" for r in MATRIX_RUNS)},
  format('{{:.2f}}', avg(win_rate)) AS "Avg." FROM rates WHERE metric = 'readability' GROUP BY run_a""")
def e8(spark, sf):
    return cmp.win_matrix(cmp.win_rate(cmp.win_counts(runs(spark, sf), ["readability"])), "readability")
