"""Registered judge, request log and chunk queries.

Runs to judge: the answers themselves ("base") and the next answers ("alt"); every fifth
conversation repeats the same answer in both. The attempt log is the events table: an event of type error is a
failed attempt, a click a successful one, the user is the task.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.functions.common import big, r9
from prefloom.operators import compare as cmp
from prefloom.operators import requests as ops
from prefloom.operators import textops
from prefloom.operators.chunks import overlap_chunks
from prefloom.plans.pairq import PAIRS, with_rejected
from prefloom.plans.prep import joined
from prefloom.plans.registry import load, query
from prefloom.plans.tables import TOKEN_TURNS, TURNS, sq, sql_count, token_turns, turns
from prefloom.plans.textq import JUDGE_SYSTEM, JUDGE_USER
from prefloom.session import keep

JUDGED = f"""{PAIRS}, jruns AS (SELECT 'base' AS run, conv_id * 100 + turn AS idx, prompt AS query, chosen AS generation FROM pairs
  UNION ALL SELECT 'alt', conv_id * 100 + turn, prompt, CASE WHEN conv_id % 5 = 0 THEN chosen ELSE rejected END FROM pairs),
  jpairs AS (SELECT a.idx, a.run AS run_a, b.run AS run_b, a.query, a.generation AS ga, b.generation AS gb FROM jruns a JOIN jruns b ON a.idx = b.idx AND a.run <> b.run),
  verdicts AS (SELECT run_a, run_b, idx, CASE WHEN idx % 7 = 0 THEN NULL ELSE (length(ga) * 3 + length(gb)) % 2 END AS verdict FROM jpairs
  WHERE ga <> gb AND NOT (idx % 11 = 0 AND run_a = 'alt'))"""


def judged_runs(spark, sf):
    p = with_rejected(turns(spark, sf), "response", "rejected").withColumn("idx", F.col("conv_id") * 100 + F.col("turn"))
    base = p.select(F.lit("base").alias("run"), "idx", "query", F.col("response").alias("generation"))
    same = F.when(F.col("conv_id") % 5 == 0, F.col("response")).otherwise(F.col("rejected"))
    return cmp.union_runs(base, p.select(F.lit("alt").alias("run"), "idx", "query", same.alias("generation")))


def judged_pairs(spark, sf):
    """Pairs of runs with their texts, made once and kept."""
    return keep(cmp.run_pairs(judged_runs(spark, sf), ["query", "generation"]), "judged")


def verdicts(pairs):
    p = pairs.filter("generation_a <> generation_b AND NOT (idx % 11 = 0 AND run_a = 'alt')")
    v = (F.length("generation_a") * 3 + F.length("generation_b")) % 2
    return p.select("run_a", "run_b", "idx", F.when(F.col("idx") % 7 != 0, v).alias("verdict"))


@query("e9_trivial_ties", f"WITH {JUDGED} SELECT run_a, run_b, idx FROM jpairs WHERE ga = gb")
def e9(spark, sf):
    return cmp.trivial_ties(judged_pairs(spark, sf)).select("run_a", "run_b", "idx")


JCOUNTS = """jc AS (SELECT p.run_a, p.run_b, count(*) FILTER (f.verdict <> s.verdict AND f.verdict = 1) AS win,
  count(*) FILTER (f.verdict <> s.verdict AND f.verdict = 0) AS lose, count(*) AS n FROM jpairs p
  LEFT JOIN verdicts f ON f.run_a = p.run_a AND f.run_b = p.run_b AND f.idx = p.idx
  LEFT JOIN verdicts s ON s.run_a = p.run_b AND s.run_b = p.run_a AND s.idx = p.idx GROUP BY ALL)"""


@query("e10_judged_counts", f"WITH {JUDGED}, {JCOUNTS} SELECT run_a, run_b, win, n - win - lose AS tie, lose FROM jc")
def e10(spark, sf):
    pairs = judged_pairs(spark, sf)
    return cmp.judged_counts(pairs, verdicts(pairs))


@query("e11_judged_win_rate", f"""WITH {JUDGED}, {JCOUNTS} SELECT run_a, run_b, round(CASE WHEN win + lose > 0
  THEN 100.0::DOUBLE * win / (win + lose) ELSE 50.0 END, 9) AS win_rate FROM jc""")
def e11(spark, sf):
    pairs = judged_pairs(spark, sf)
    out = cmp.win_rate(cmp.judged_counts(pairs, verdicts(pairs)))
    return out.select("run_a", "run_b", r9("win_rate").alias("win_rate"))


@query("e12_union_runs", f"WITH {JUDGED} SELECT run, idx, query, generation FROM jruns")
def e12(spark, sf):
    return judged_runs(spark, sf)


@query("q1_judge_requests", f"""WITH {JUDGED} SELECT run_a, run_b, idx, 'judge' AS model, replace(replace(replace({sq(JUDGE_USER)},
  '{{instruction}}', query), '{{output_1}}', ga), '{{output_2}}', gb) AS user_text, idx::VARCHAR AS id, 'name_best_answer' AS tool,
  ({sql_count(text.TOKEN, sq(JUDGE_SYSTEM))} + {sql_count(text.TOKEN, 'user_text')} + 25)::BIGINT AS max_tokens, 0::BIGINT AS temperature, {sq(JUDGE_SYSTEM)} AS system_text FROM jpairs WHERE ga <> gb""")
def q1(spark, sf):
    out = ops.judge_requests(judged_pairs(spark, sf), F.lit(textops.DEFAULT_JUDGE_TEMPLATE), "judge")
    get = lambda path: F.get_json_object("request", path)
    return out.select(
        "run_a", "run_b", "idx", get("$.model").alias("model"), get("$.messages[1].content").alias("user_text"),
        get("$.metadata.id").alias("id"), get("$.tools[0].function.name").alias("tool"),
        get("$.max_tokens").cast("bigint").alias("max_tokens"), get("$.temperature").cast("bigint").alias("temperature"), get("$.messages[0].content").alias("system_text"),
    )


USER_SQL = f"""replace(replace(replace({sq(JUDGE_USER)}, '{{instruction}}', query), '{{output_1}}', response), '{{output_2}}', query)"""


def conversations_for_cost(spark, sf):
    conv = textops.judge_conversation(F.lit(textops.DEFAULT_JUDGE_TEMPLATE), F.col("query"), F.col("response"), F.col("query"))
    return turns(spark, sf).withColumn("messages", conv)


@query("q2_request_budget", f"""WITH {TURNS}, m AS (SELECT conv_id, turn, {USER_SQL} AS u FROM turns)
  SELECT conv_id, turn, ({sql_count(text.TOKEN, sq(JUDGE_SYSTEM))} + {sql_count(text.TOKEN, 'u')} + 25)::BIGINT AS budget FROM m""")
def q2(spark, sf):
    return conversations_for_cost(spark, sf).select("conv_id", "turn", big(ops.request_budget(F.col("messages"))).alias("budget"))


@query("q3_chat_cost", f"""WITH {TURNS}, m AS (SELECT conv_id, turn, {USER_SQL} AS u FROM turns)
  SELECT conv_id, turn, ({sql_count(text.TOKEN, sq(JUDGE_SYSTEM))} + {sql_count(text.TOKEN, 'u')} + 2 * 4 + 2 + 2
  + (turn % 2 + 1) * CASE WHEN conv_id % 3 = 0 THEN 15 ELSE 20 END)::BIGINT AS cost FROM m""")
def q3(spark, sf):
    c = conversations_for_cost(spark, sf)
    cap = F.when(F.col("conv_id") % 3 != 0, F.lit(20))
    return c.select("conv_id", "turn", big(ops.request_cost("chat", F.col("messages"), F.col("turn") % 2 + 1, cap)).alias("cost"))


@query("q4_completion_cost", f"""WITH {TURNS} SELECT conv_id, turn, ({sql_count(text.TOKEN, 'query')} + 15 * 3
  + CASE WHEN turn % 2 = 0 THEN {sql_count(text.TOKEN, 'response')} + 15 * 3 ELSE 0 END)::BIGINT AS cost FROM turns""")
def q4(spark, sf):
    prompts = F.when(F.col("turn") % 2 == 0, F.array("query", "response")).otherwise(F.array("query"))
    cost = ops.request_cost("completion", prompts, F.lit(3), F.lit(None).cast("int"))
    return turns(spark, sf).select("conv_id", "turn", big(cost).alias("cost"))


@query("q5_embedding_cost", f"WITH {TURNS} SELECT conv_id, turn, ({sql_count(text.TOKEN, 'query')} + {sql_count(text.TOKEN, 'response')})::BIGINT AS cost FROM turns")
def q5(spark, sf):
    none = F.lit(None).cast("int")
    return turns(spark, sf).select("conv_id", "turn", big(ops.request_cost("embedding", F.array("query", "response"), none, none)).alias("cost"))


@query("q6_task_ids", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1)::BIGINT AS task_id FROM events")
def q6(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "ts")
    return ops.task_ids(ev, ["ts", "event_id"]).select("event_id", "task_id")


LOG = """log AS (SELECT user_id AS task_id, ts, event_id AS attempt, event_type = 'click' AS ok, event_id % 3 < 2 AS api,
  CASE WHEN event_type = 'error' THEN ['Rate limit reached', 'Server overloaded', 'timeout'][event_id % 3 + 1] END AS error,
  floor(value)::BIGINT AS tokens FROM events WHERE event_type IN ('error', 'click'))"""
STATUS = """firstok AS (SELECT task_id, min({'ts': ts, 'attempt': attempt}) AS o FROM log WHERE ok GROUP BY task_id),
  errs AS (SELECT l.task_id, l.error, row_number() OVER (PARTITION BY l.task_id ORDER BY ts, attempt) AS rn FROM log l
  LEFT JOIN firstok USING (task_id) WHERE NOT l.ok AND (o IS NULL OR {'ts': l.ts, 'attempt': l.attempt} < o)),
  per AS (SELECT t.task_id, count(rn) AS n, string_agg(error, ',' ORDER BY rn) FILTER (rn <= 5) AS errors FROM (SELECT DISTINCT task_id FROM log) t
  LEFT JOIN errs USING (task_id) GROUP BY t.task_id),
  status AS (SELECT task_id, CASE WHEN n >= 5 THEN 'failed' WHEN o IS NOT NULL THEN 'succeeded' ELSE 'pending' END AS status,
  coalesce(errors, '') AS errors FROM per LEFT JOIN firstok USING (task_id))"""


def attempt_log(spark, sf):
    e = load(spark, sf, "events").filter("event_type IN ('error', 'click')")
    kinds = F.array(F.lit("Rate limit reached"), F.lit("Server overloaded"), F.lit("timeout"))
    return e.select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("attempt"), (F.col("event_type") == "click").alias("ok"),
        (F.col("event_id") % 3 < 2).alias("api"),
        F.when(F.col("event_type") == "error", F.element_at(kinds, (F.col("event_id") % 3 + 1).cast("int"))).alias("error"),
        F.floor("value").alias("tokens"),
    )


@query("q7_task_status", f"WITH {LOG}, {STATUS} SELECT * FROM status")
def q7(spark, sf):
    return ops.task_status(attempt_log(spark, sf)).withColumn("errors", F.array_join("errors", ","))


@query("q8_status_counts", f"""WITH {LOG}, {STATUS} SELECT count(*) AS started, count(*) FILTER (status = 'pending') AS in_progress,
  count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  (SELECT count(*) FILTER (error LIKE 'Rate limit%') FROM log) AS rate_limit_errors,
  (SELECT count(*) FILTER (NOT ok AND api AND error NOT LIKE 'Rate limit%') FROM log) AS api_errors,
  (SELECT count(*) FILTER (NOT ok AND NOT api) FROM log) AS other_errors FROM status""")
def q8(spark, sf):
    return ops.status_counts(attempt_log(spark, sf))


@query("q9_pending", f"""WITH {LOG} SELECT DISTINCT task_id FROM log WHERE task_id NOT IN (SELECT task_id FROM log WHERE ok AND tokens > 40)
  AND task_id NOT IN (SELECT task_id FROM log WHERE NOT ok GROUP BY task_id HAVING count(*) >= 60)""")
def q9(spark, sf):
    log = attempt_log(spark, sf)
    return ops.pending(log.select("task_id").distinct(), log.filter("ok AND tokens > 40"), log, 60)


@query("q10_usage", f"""WITH {LOG} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, sum(tokens)::BIGINT AS tokens,
  count(*) > 1 AS over_requests, sum(tokens) > 30 AS over_tokens FROM log GROUP BY date_trunc('minute', ts)""")
def q10(spark, sf):
    out = ops.usage(attempt_log(spark, sf), 1, 30)
    return out.withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


COOL = """hits AS (SELECT ts, lag(ts) OVER (ORDER BY ts) AS p FROM log WHERE error LIKE 'Rate limit%'),
  g AS (SELECT ts, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL {gap} THEN 1 ELSE 0 END) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM hits)
  SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL {gap}) AS end_us, count(*) AS n_errors FROM g GROUP BY g"""

for _name, _seconds in (("q11_cooldowns", 15), ("q11_cooldowns_long", 7200)):
    def _cool(spark, sf, seconds=_seconds):
        out = ops.cooldowns(attempt_log(spark, sf), seconds)
        return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_errors")

    query(_name, f"WITH {LOG}, {COOL.format(gap=f'{_seconds} SECONDS')}")(_cool)


@query("c1_overlap_chunks", f"""WITH {TOKEN_TURNS}, p AS (SELECT conv_id, turn, list_resize(response_ids, ceil(len(response_ids) / 64.0)::INT * 64, 0) AS ids FROM token_turns),
  c AS (SELECT *, unnest(range(0, len(ids) // 32 - 1)) AS chunk FROM p)
  SELECT conv_id, turn, chunk, array_to_string(ids[chunk * 32 + 1:chunk * 32 + 64], ',') AS ids FROM c""")
def c1(spark, sf):
    out = overlap_chunks(token_turns(spark, sf), F.col("response_ids"), 32)
    return out.select("conv_id", "turn", "chunk", joined("chunk_ids").alias("ids"))
