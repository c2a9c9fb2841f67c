"""Registered reward construction queries.

Inputs: conversation answers with their sentences as segments. Class logits of a segment are stand-ins computed
from its text: remainders of its length, of its offset and of its token count.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import rewards, text
from prefloom.functions.common import big, r6
from prefloom.operators import rewards as ops
from prefloom.operators import textops
from prefloom.plans.registry import load, query
from prefloom.plans.tables import RUNS, TURNS, runs, sql_count, turns
from prefloom.plans.textq import sentence_rows

KEYS = ["conv_id", "turn"]


def segments(spark, sf):
    t = turns(spark, sf).withColumn("length", text.token_count("response"))
    s = textops.segments(t, "response", text.sentence_ends("response"), F.col("length"))
    n = F.length("segment")
    return s.select(
        *KEYS, "length", "seg", "end_pos",
        F.array((n % 7) / 7.0, (F.col("start") % 5) / 5.0, (F.col("end_pos") % 3) / 3.0).alias("logits"),
    )


SEGMENTS = f"""{TURNS}, {sentence_rows('turns', 'conv_id, turn', 'response')},
  seg0 AS (SELECT conv_id, turn, {sql_count(text.TOKEN, 'response')} AS length, seg, length(sent) AS n, b AS start,
  least({sql_count(text.TOKEN, 'response[:e]')} - 1, {sql_count(text.TOKEN, 'response')} - 1) AS end_pos
  FROM sents JOIN turns USING (conv_id, turn)),
  segs AS (SELECT conv_id, turn, length, seg, end_pos, (n % 7) / 7.0::DOUBLE AS l0, (start % 5) / 5.0::DOUBLE AS l1,
  (end_pos % 3) / 3.0::DOUBLE AS l2 FROM seg0)"""
TOKENS = f"toks AS (SELECT conv_id, turn, {sql_count(text.TOKEN, 'response')} AS length, unnest(range(0, {sql_count(text.TOKEN, 'response')})) AS pos FROM turns)"
VERBOSE = "l2 > l1"
FACTUAL = "l2 > l0"


def scattered(cond: str) -> str:
    return f"""(SELECT t.conv_id, t.turn, t.pos, coalesce(x.r, 0.0) AS r FROM toks t LEFT JOIN
  (SELECT conv_id, turn, end_pos, arg_max(CASE WHEN {cond} THEN 1.0 ELSE -1.0 END, seg) AS r FROM segs GROUP BY ALL) x
  ON x.conv_id = t.conv_id AND x.turn = t.turn AND x.end_pos = t.pos)"""


def long(df, c="rewards", keys=KEYS):
    out = df.select(*keys, F.posexplode(c).alias("pos", "r"))
    return out.select(*keys, big("pos").alias("pos"), r6("r").alias("reward"))


@query("w1_znorm", """WITH f AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS s FROM documents)
  SELECT doc_id, round((n_chars - m) / s, 6) AS fitted, round((n_chars - -0.447) / 8.301 * 0.3 + 0.5, 6) AS given FROM documents, f""")
def w1(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    out = ops.fit_znorm(docs, "n_chars", "fitted")
    return out.select("doc_id", r6("fitted").alias("fitted"), r6(rewards.znorm("n_chars", -0.447, 8.301, 0.3, 0.5)).alias("given"))


@query("w2_shape", """SELECT event_id, round(1.0 / (1.0 + exp(-value)) - 0.1, 6) AS shaped, round(value, 6) AS plain FROM events""")
def w2(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", r6(rewards.shape("value", True, 0.1)).alias("shaped"), r6(rewards.shape("value")).alias("plain")
    )


@query("w3_last_token_reward", f"""WITH {TURNS}, {TOKENS} SELECT conv_id, turn, pos::BIGINT AS pos,
  CASE WHEN pos = length - 1 THEN round(length / 36.0::DOUBLE, 6) ELSE 0.0 END::DOUBLE AS reward FROM toks""")
def w3(spark, sf):
    t = turns(spark, sf).withColumn("n", text.token_count("response"))
    return long(t.withColumn("rewards", rewards.last_token_reward(F.col("n"), F.col("n") / F.lit(36.0))))


@query("w4_segment_label", f"WITH {SEGMENTS} SELECT conv_id, turn, seg::BIGINT AS seg, {VERBOSE} AS verbosity_ok, {FACTUAL} AS factuality_ok FROM segs")
def w4(spark, sf):
    kinds = [rewards.segment_correct(F.col("logits"), k).alias(f"{k}_ok") for k in ("verbosity", "factuality")]
    return segments(spark, sf).select(*KEYS, "seg", *kinds)


@query("w5_scatter_reward", f"WITH {SEGMENTS}, {TOKENS} SELECT conv_id, turn, pos::BIGINT AS pos, r::DOUBLE AS reward FROM {scattered(VERBOSE)}")
def w5(spark, sf):
    return long(ops.scatter_reward(segments(spark, sf), KEYS, "verbosity"))


@query("w6_segment_counts", f"""WITH {SEGMENTS} SELECT conv_id, turn, count(*) AS n_segments, count(*) FILTER ({FACTUAL}) AS n_correct
  FROM segs GROUP BY conv_id, turn""")
def w6(spark, sf):
    return ops.segment_counts(segments(spark, sf), KEYS, "factuality")


@query("w7_correct_rate", f"""WITH {SEGMENTS}, c AS (SELECT t.conv_id, t.turn, count(seg) AS n, count(seg) FILTER ({FACTUAL}) AS k
  FROM turns t LEFT JOIN segs s ON s.conv_id = t.conv_id AND s.turn = t.turn GROUP BY ALL)
  SELECT count(*) AS responses, round(avg(CASE WHEN n > 0 THEN k::DOUBLE / n ELSE 0.5 END), 6) AS rate FROM c""")
def w7(spark, sf):
    rate = rewards.correct_rate(F.col("n_correct"), F.col("n_segments"))
    counts = ops.segment_counts(segments(spark, sf), KEYS, "factuality")
    return counts.agg(F.count(F.lit(1)).alias("responses"), r6(F.avg(rate)).alias("rate"))


ASPECT = f"""aspect AS (SELECT v.conv_id, v.turn, v.pos, 0.3 * v.r + 0.5 * f.r + 0.2 * CASE WHEN v.pos = t.length - 1 THEN t.length / 36.0::DOUBLE ELSE 0.0 END AS r, t.length
  FROM {scattered(VERBOSE)} v JOIN {scattered(FACTUAL)} f ON v.conv_id = f.conv_id AND v.turn = f.turn AND v.pos = f.pos
  JOIN toks t ON t.conv_id = v.conv_id AND t.turn = v.turn AND t.pos = v.pos)"""


def aspects(spark, sf):
    """Combined token rewards per answer: ``conv_id, turn, length, aspect``."""
    s = ops.scatter_rewards(segments(spark, sf), KEYS, ["verbosity", "factuality"])
    c = rewards.last_token_reward(F.col("length"), F.col("length") / F.lit(36.0))
    parts = F.col("rewards_verbosity"), F.col("rewards_factuality"), F.col("c")
    return s.withColumn("c", c).select(*KEYS, "length", rewards.combine(*parts, (0.3, 0.5, 0.2)).alias("aspect"))


@query("w8_combine", f"WITH {SEGMENTS}, {TOKENS}, {ASPECT} SELECT conv_id, turn, pos::BIGINT AS pos, round(r, 6)::DOUBLE AS reward FROM aspect")
def w8(spark, sf):
    return long(aspects(spark, sf), "aspect")


@query("w9_mt_aspect_reward", f"""WITH {TURNS}, {TOKENS} SELECT conv_id, turn, pos::BIGINT AS pos, round(2 * -(pos % 2)
  + CASE WHEN pos = length - 1 THEN 3 * (1.0 / (1.0 + exp(-(length - 11.199) / 6.044))) + 1 / (1.0 + exp(-(conv_id % 10) / 10.0::DOUBLE)) ELSE 0 END, 6)::DOUBLE AS reward FROM toks""")
def w9(spark, sf):
    n = F.col("n")
    t = turns(spark, sf).withColumn("n", text.token_count("response")).withColumn(
        "g", F.transform(F.array_repeat(F.lit(0), n), lambda _, i: -(i % 2).cast("double"))
    )
    aspect = rewards.mt_aspect(
        F.col("g"), rewards.znorm("n", 11.199, 6.044), (F.col("conv_id") % 10) / 10.0, (2.0, 3.0, 1.0), sigmoid=True
    )
    return long(t.withColumn("rewards", aspect))


HOLISTIC = "((length % 20) / 10.0::DOUBLE - 0.5)"


def strategy_sql(kind: str) -> str:
    last = f"CASE WHEN pos = length - 1 THEN 3.0 * {HOLISTIC} ELSE 0.0 END"
    value = {
        "holistic_only": last,
        "aspect_only": "r",
        "weighted_sum": f"r + {last}",
        "hierarchical": f"CASE WHEN {HOLISTIC} < 0.6 THEN {last} ELSE r + {last} END",
    }[kind]
    return f"WITH {SEGMENTS}, {TOKENS}, {ASPECT} SELECT conv_id, turn, pos::BIGINT AS pos, round({value}, 6)::DOUBLE AS reward FROM aspect"


def scored(spark, sf, kind):
    a = aspects(spark, sf).withColumn("holistic", (F.col("length") % 20) / 10.0 - 0.5)
    return a.withColumn("rewards", rewards.strategy(kind, F.col("aspect"), F.col("holistic"), F.col("length"), 3.0, 0.6))


def register_strategy(name: str, kind: str) -> None:
    query(name, strategy_sql(kind))(lambda spark, sf: long(scored(spark, sf, kind)))


register_strategy("w10_holistic_only", "holistic_only")
register_strategy("w11_aspect_only", "aspect_only")
register_strategy("w12_weighted_sum", "weighted_sum")
register_strategy("w13_hierarchical", "hierarchical")


@query("w14_short_override", f"""WITH {SEGMENTS}, {TOKENS}, {ASPECT} SELECT conv_id, turn, pos::BIGINT AS pos, round(
  CASE WHEN length <= 15 THEN CASE WHEN pos = length - 1 THEN -30.0 ELSE 0.0 END
  ELSE r + CASE WHEN pos = length - 1 THEN 3.0 * {HOLISTIC} ELSE 0.0 END END, 6)::DOUBLE AS reward FROM aspect""")
def w14(spark, sf):
    s = scored(spark, sf, "weighted_sum")
    return long(s.withColumn("rewards", rewards.short_override(F.col("rewards"), F.col("length") <= 15, F.col("length"), 3.0)))


@query("w15_length_reward", f"""WITH {SEGMENTS}, {TOKENS}, {ASPECT} SELECT conv_id, turn, pos::BIGINT AS pos, round(
  CASE WHEN pos = length - 1 THEN length / 96.79 + 3.0 * {HOLISTIC} ELSE 0.0 END, 6)::DOUBLE AS reward FROM aspect""")
def w15(spark, sf):
    a = aspects(spark, sf).withColumn("holistic", (F.col("length") % 20) / 10.0 - 0.5)
    a = a.withColumn("aspect", rewards.length_reward(F.col("length"), 96.79))
    return long(a.withColumn("rewards", rewards.strategy("weighted_sum", F.col("aspect"), F.col("holistic"), F.col("length"), 3.0)))


def report_sql(how: str) -> str:
    last = f"CASE WHEN pos = length - 1 THEN 3.0 * {HOLISTIC} ELSE 0.0 END"
    return f"""WITH {SEGMENTS}, {TOKENS}, {ASPECT}, p AS (SELECT conv_id, turn, any_value(length) AS length, any_value({HOLISTIC}) AS h,
  {'sum' if how == 'eval' else 'avg'}(CASE WHEN {HOLISTIC} < 0.6 THEN {last} ELSE r + {last} END) AS r FROM aspect GROUP BY conv_id, turn)
  SELECT round(avg(h), 6) AS holistic, round(avg(length), 6) AS length, round(avg(r), 6) AS reward FROM p"""


def report(spark, sf, how):
    out = ops.reward_report(scored(spark, sf, "hierarchical"), ["holistic", "length"], "rewards", how)
    return out.select(*[r6(c).alias(c) for c in out.columns])


query("w16_reward_report_eval", report_sql("eval"))(lambda spark, sf: report(spark, sf, "eval"))
query("w16_reward_report_test", report_sql("test"))(lambda spark, sf: report(spark, sf, "test"))


@query("w17_last_attended", """SELECT vec_id, round(embedding[greatest(vec_id % 65, 1)]::DOUBLE, 6) AS score FROM embeddings""")
def w17(spark, sf):
    e = load(spark, sf, "embeddings").select(
        "vec_id", "embedding",
        F.transform("embedding", lambda _, i: (i < F.col("vec_id") % 65).cast("int")).alias("mask"),
    )
    return e.select("vec_id", r6(rewards.last_attended(F.col("embedding"), F.col("mask"))).alias("score"))


@query("s10_sample_log", f"""WITH {SEGMENTS}, {TOKENS}, {ASPECT} SELECT t.query, t.response, round(sum(r), 6)::DOUBLE AS reward
  FROM aspect a JOIN turns t ON t.conv_id = a.conv_id AND t.turn = a.turn GROUP BY a.conv_id, a.turn, t.query, t.response""")
def s10(spark, sf):
    rows = aspects(spark, sf).join(turns(spark, sf), KEYS)
    out = ops.sample_log(rows, "query", "response", "aspect")
    return out.withColumn("reward", r6("reward"))


# the flow from measures to gated rewards in one plan, over whole documents
@query("mt_reward_flow", f"""WITH {RUNS}, z AS (SELECT doc_id, run, response_length AS n, grammar_errors, (readability - 11.199) / 6.044 AS read,
  (holistic_reward - 6.5) / 1.5 AS h FROM runs) SELECT run, count(*) AS responses, round(avg(h), 6) AS holistic,
  round(avg(CASE WHEN n <= 2 THEN -30.0 WHEN h < 0.5 THEN 3.0 * h ELSE -grammar_errors + read + 3.0 * h END), 6)::DOUBLE AS reward FROM z GROUP BY run""")
def mt_flow(spark, sf):
    h = rewards.znorm("holistic_reward", 6.5, 1.5)
    aspect = -F.col("grammar_errors") + rewards.znorm("readability", 11.199, 6.044)
    short = F.col("response_length") <= 2
    total = (
        F.when(short, F.lit(3.0 * rewards.SHORT_SCORE))
        .when(F.col("h") < 0.5, F.col("h") * 3.0).otherwise(aspect + F.col("h") * 3.0)
    )
    return runs(spark, sf).withColumn("h", h).groupBy("run").agg(
        F.count(F.lit(1)).alias("responses"), r6(F.avg("h")).alias("holistic"), r6(F.avg(total)).alias("reward")
    )
