"""Registered preference pair, packing and selection queries.

A pair: the user turn, its answer as chosen, and the next answer in the order of (conversation, turn) as rejected; the first answer
follows the last, so every answer is in one pair as chosen and in one as rejected.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.functions.common import big, r9
from prefloom.operators import pairs as ops
from prefloom.operators.ordering import positions
from prefloom.operators.prep import ones
from prefloom.plans.prep import joined
from prefloom.plans.registry import load, query
from prefloom.plans.tables import TOKEN_TURNS, TURNS, documents, sql_count, sql_ids, token_turns, turns

KEYS = ["conv_id", "turn"]
PLACED = "SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS i, count(*) OVER () AS n FROM"
PAIRS = f"""{TURNS}, placed AS ({PLACED} turns), pairs AS (SELECT a.conv_id, a.turn, a.query AS prompt, a.response AS chosen, b.response AS rejected
  FROM placed a JOIN placed b ON b.i = (a.i + 1) % a.n)"""
SCORED = PAIRS + """, scored AS (SELECT *, length(chosen) / 100.0::DOUBLE AS rc, length(rejected) / 100.0::DOUBLE AS rr,
  -length(chosen) / 50.0::DOUBLE AS pc, -length(rejected) / 50.0::DOUBLE AS pr, -(length(chosen) % 7) / 5.0::DOUBLE AS fc,
  -(length(rejected) % 5) / 5.0::DOUBLE AS fr FROM pairs)"""
TPAIRS = f"""{TOKEN_TURNS}, tplaced AS ({PLACED} token_turns), tpairs AS (SELECT a.conv_id, a.turn, a.conv_id % 8 AS batch, a.query_ids AS p, a.response_ids AS c,
  b.response_ids AS r FROM tplaced a JOIN tplaced b ON b.i = (a.i + 1) % a.n)"""


def with_rejected(t, column, out):
    placed = positions(t, KEYS, out="_i")
    n = t.agg(F.count(F.lit(1))).scalar()
    other = placed.select(F.pmod(F.col("_i") - 1, n).alias("_i"), F.col(column).alias(out))
    return placed.join(other, "_i").drop("_i")


def scored(spark, sf):
    p = with_rejected(turns(spark, sf), "response", "rejected")
    c, r = F.length("response"), F.length("rejected")
    return p.select(
        *KEYS, F.col("query").alias("prompt"), F.col("response").alias("chosen"), "rejected",
        (c / 100.0).alias("rc"), (r / 100.0).alias("rr"), (-c / 50.0).alias("policy_chosen"), (-r / 50.0).alias("policy_rejected"),
        (-(c % 7) / 5.0).alias("ref_chosen"), (-(r % 5) / 5.0).alias("ref_rejected"),
    )


def token_pairs(spark, sf):
    p = with_rejected(token_turns(spark, sf), "response_ids", "rejected_ids")
    return p.select(*KEYS, (F.col("conv_id") % 8).alias("batch"), F.col("query_ids").alias("prompt_ids"), F.col("response_ids").alias("chosen_ids"), "rejected_ids")


LOSS = "(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@query("d1_pair_loss", f"WITH {SCORED} SELECT conv_id, turn, round({LOSS.format(x='(rr - rc)')}, 9) AS loss FROM scored")
def d1(spark, sf):
    return scored(spark, sf).select(*KEYS, r9(ops.pair_loss(F.col("rc"), F.col("rr"))).alias("loss"))


@query("d2_pair_prob", f"WITH {SCORED} SELECT conv_id, turn, round(1 / (1 + exp(rr - rc)), 9) AS prob FROM scored")
def d2(spark, sf):
    return scored(spark, sf).select(*KEYS, r9(ops.pair_prob(F.col("rc"), F.col("rr"))).alias("prob"))


@query("d3_pair_accuracy", f"WITH {SCORED} SELECT round(avg({LOSS.format(x='(rr - rc)')}), 9) AS loss, round(avg((rc >= rr)::INT), 9) AS accuracy FROM scored")
def d3(spark, sf):
    out = ops.pair_report(scored(spark, sf), "rc", "rr")
    return out.select(r9("loss").alias("loss"), r9("accuracy").alias("accuracy"))


@query("d4_sequence_logp", """WITH z AS (SELECT vec_id, vec_id // 10 AS seq, vec_id % 10 AS pos, CASE WHEN vec_id % 4 = 0 THEN -100 ELSE label END AS label, embedding FROM embeddings),
  p AS (SELECT a.seq, CASE WHEN b.label <> -100 THEN a.embedding[b.label + 1]::DOUBLE - ln(list_sum(list_transform(a.embedding, lambda x: exp(x::DOUBLE)))) END AS lp
  FROM z a JOIN z b ON a.seq = b.seq AND b.pos = a.pos + 1) SELECT seq::BIGINT AS seq, round(coalesce(sum(lp), 0), 9) AS logp_sum, round(avg(lp), 9) AS logp_mean FROM p GROUP BY seq""")
def d4(spark, sf):
    e = load(spark, sf, "embeddings")
    z = e.select(
        F.floor(F.col("vec_id") / 10).alias("seq"), (F.col("vec_id") % 10).alias("pos"), F.col("embedding").cast("array<double>").alias("logits"),
        F.when(F.col("vec_id") % 4 == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
    )
    out = ops.sequence_logp(z, "seq", "pos", "logits", "label")
    return out.select("seq", r9("logp_sum").alias("logp_sum"), r9("logp_mean").alias("logp_mean"))


@query("d5_dpo", f"""WITH {SCORED} SELECT conv_id, turn, round({LOSS.format(x='(-0.1 * ((pc - pr) - (fc - fr)))')}, 9) AS loss,
  round({LOSS.format(x='(-0.1 * (pc - pr))')}, 9) AS loss_free, round(0.1 * (pc - fc), 9) AS reward_chosen, round(0.1 * (pr - fr), 9) AS reward_rejected FROM scored""")
def d5(spark, sf):
    s = scored(spark, sf)
    free = ops.dpo(s, 0.1, True).withColumnRenamed("loss", "loss_free").drop("reward_chosen", "reward_rejected")
    out = ops.dpo(free, 0.1)
    return out.select(*KEYS, *[r9(c).alias(c) for c in ("loss", "loss_free", "reward_chosen", "reward_rejected")])


@query("d6_dpo_report", f"""WITH {SCORED}, d AS (SELECT *, 0.1 * (pc - fc) AS c, 0.1 * (pr - fr) AS r, {LOSS.format(x='(-0.1 * ((pc - pr) - (fc - fr)))')} AS l FROM scored)
  SELECT round(avg(l), 9) AS eval_loss, round(avg(c), 9) AS eval_rewards_chosen, round(avg(r), 9) AS eval_rewards_rejected,
  round(avg((c > r)::INT), 9) AS eval_rewards_accuracies, round(avg(c - r), 9) AS eval_rewards_margins, round(avg(pc), 9) AS eval_logps_chosen,
  round(avg(pr), 9) AS eval_logps_rejected FROM d""")
def d6(spark, sf):
    out = ops.dpo_report(ops.dpo(scored(spark, sf)), "eval_")
    return out.select(*[r9(f"`{c}`").alias(c.replace("/", "_")) for c in out.columns])


@query("d7_metric_flush", """WITH f AS (SELECT event_type, value, sum((event_type = 'error')::INT) OVER (ORDER BY ts, event_id) AS flush FROM events)
  SELECT flush::BIGINT AS flush, event_type, round(avg(value), 9) AS mean FROM f WHERE event_type <> 'error' GROUP BY ALL""")
def d7(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    out = ops.metric_flush(ev, F.col("event_type") == "error", ["ts", "event_id"], "event_type", "value")
    return out.withColumn("mean", r9("mean"))


def feature_sql(mode: str) -> str:
    keep = "p[1:64]" if mode == "keep_start" else "p[greatest(len(p) - 63, 1):]"
    return f"""{TPAIRS}, f0 AS (SELECT conv_id, turn, batch, p, list_append(c, 1) AS c, list_append(r, 1) AS r FROM tpairs),
  f1 AS (SELECT *, greatest(len(c), len(r)) AS m, CASE WHEN len(p) + greatest(len(c), len(r)) > 128 THEN {keep} ELSE p END AS q FROM f0),
  feats AS (SELECT conv_id, turn, batch, q, CASE WHEN len(q) + m > 128 THEN c[1:64] ELSE c END AS c, CASE WHEN len(q) + m > 128 THEN r[1:64] ELSE r END AS r FROM f1)"""


FEATURE_OUT = """SELECT conv_id, turn, array_to_string(list_concat(q, c), ',') AS chosen_input_ids, array_to_string(list_concat(q, r), ',') AS rejected_input_ids,
  array_to_string(list_concat(list_transform(q, lambda x: -100), c), ',') AS chosen_labels, array_to_string(q, ',') AS prompt_input_ids FROM feats"""

for _mode in ("keep_end", "keep_start"):
    def _features(spark, sf, mode=_mode):
        out = ops.dpo_features(token_pairs(spark, sf), 128, 64, mode)
        names = ("chosen_input_ids", "rejected_input_ids", "chosen_labels", "prompt_input_ids")
        return out.select(*KEYS, *[joined(c).alias(c) for c in names])

    query(f"d8_dpo_features_{_mode}", f"WITH {feature_sql(_mode)} {FEATURE_OUT}")(_features)


def sql_joined(array: str, out: str) -> str:
    return f"array_to_string({array}, ',') AS {out}"


def sql_ones(array: str) -> str:
    return f"list_transform({array}, lambda x: 1)"


SIDES = {"chosen": "c", "rejected": "r"}
PARTS = ("input_ids", "attention_mask", "labels")
D9_SQL = ",\n  ".join(
    [sql_joined(f"list_concat(list_transform(range(0, np - len(q)), lambda x: 0), {x})", f"prompt_{n}") for n, x in (("input_ids", "q"), ("attention_mask", sql_ones("q")))]
    + [sql_joined(f"list_resize({x}, n{v}, {pad})", f"{side}_{n}") for side, v in SIDES.items() for n, x, pad in (
        ("input_ids", f"list_concat(q, {v})", 0), ("attention_mask", sql_ones(f"list_concat(q, {v})"), 0),
        ("labels", f"list_concat(list_transform(q, lambda x: -100), {v})", -100))]
)


@query("d9_collate", f"""WITH {feature_sql('keep_end')}, n AS (SELECT *, max(len(q)) OVER (PARTITION BY batch) AS np, max(len(q) + len(c)) OVER (PARTITION BY batch) AS nc,
  max(len(q) + len(r)) OVER (PARTITION BY batch) AS nr FROM feats) SELECT conv_id, turn, {D9_SQL} FROM n""")
def d9(spark, sf):
    out = ops.collate_dpo(ops.dpo_features(token_pairs(spark, sf), 128, 64), ["batch"])
    names = ["prompt_input_ids", "prompt_attention_mask", *[f"{side}_{n}" for side in SIDES for n in PARTS]]
    return out.select(*KEYS, *[joined(c).alias(c) for c in names])


D10_SQL = ", ".join(sql_joined(f"list_resize({x}, n{v}, 0)", f"{n}_{side}") for side, v in SIDES.items() for n, x in (("input_ids", v), ("attention_mask", sql_ones(v))))


@query("d10_reward_collate", f"""WITH {TPAIRS}, n AS (SELECT *, ceil(max(len(c)) OVER (PARTITION BY batch) / 8.0)::INT * 8 AS nc, ceil(max(len(r)) OVER (PARTITION BY batch) / 8.0)::INT * 8 AS nr FROM tpairs)
  SELECT conv_id, turn, {D10_SQL} FROM n""")
def d10(spark, sf):
    p = token_pairs(spark, sf).select(
        *KEYS, "batch", F.col("chosen_ids").alias("input_ids_chosen"), ones(F.size("chosen_ids")).alias("attention_mask_chosen"),
        F.col("rejected_ids").alias("input_ids_rejected"), ones(F.size("rejected_ids")).alias("attention_mask_rejected"),
    )
    out = ops.reward_collate(p, ["batch"], 8)
    return out.select(*KEYS, *[joined(c).alias(c) for c in ops.REWARD_COLUMNS])


D11_SQL = " UNION ALL ".join(
    f"SELECT conv_id, turn, '{side}' AS side, {sql_joined(f'list_resize(list_concat(q, {v}), n, 0)', 'input_ids')}, "
    f"{sql_joined(f'list_resize({sql_ones(f'list_concat(q, {v})')}, n, 0)', 'attention_mask')}, "
    f"{sql_joined(f'list_resize(list_concat(list_transform(q, lambda x: -100), {v}), n, -100)', 'labels')} FROM n"
    for side, v in SIDES.items()
)


@query("d11_concat_pairs", f"""WITH {feature_sql('keep_end')}, n AS (SELECT *, max(greatest(len(q) + len(c), len(q) + len(r))) OVER (PARTITION BY batch) AS n FROM feats)
  {D11_SQL}""")
def d11(spark, sf):
    out = ops.concat_pairs(ops.dpo_features(token_pairs(spark, sf), 128, 64), KEYS, ["batch"])
    return out.select(*KEYS, "side", *[joined(c).alias(c) for c in PARTS])


INSTR, RESP = (3, 4), (5, 6)


def marked(spark, sf):
    m = {n: F.array(*[F.lit(x) for x in v]) for n, v in (("i", INSTR), ("r", RESP))}
    ids = F.concat(m["i"], "query_ids", m["r"], "response_ids", m["i"], "response_ids", m["r"], "query_ids", m["i"], "query_ids")
    return token_turns(spark, sf).select(*KEYS, ids.alias("ids"))


MARKED_ENDS = "len(query_ids) + 4"  # end of the first response marker
FLAT = "list_concat(list_concat(list_concat([3, 4], query_ids), list_concat([5, 6], response_ids)), list_concat(list_concat([3, 4], response_ids), list_concat(list_concat([5, 6], query_ids), list_concat([3, 4], query_ids))))"


@query("d13_completion_mask", f"""WITH {TOKEN_TURNS}, m AS (SELECT conv_id, turn, {FLAT} AS ids, 8 + len(query_ids) + 2 * len(response_ids) AS e FROM token_turns)
  SELECT conv_id, turn, array_to_string(list_transform(ids, lambda t, i: CASE WHEN i <= e THEN -100 ELSE t END), ',') AS labels FROM m""")
def d13(spark, sf):
    return marked(spark, sf).select(*KEYS, joined(ops.completion_mask(F.col("ids"), RESP)).alias("labels"))


@query("d14_completion_mask_turns", f"""WITH {TOKEN_TURNS}, m AS (SELECT conv_id, turn, {FLAT} AS ids, len(query_ids) AS q, len(response_ids) AS r FROM token_turns)
  SELECT conv_id, turn, array_to_string(list_transform(ids, lambda t, i: CASE WHEN i <= q + 4 OR (i > q + r + 4 AND i <= q + 2 * r + 8) OR i > 2 * q + 2 * r + 8 THEN -100 ELSE t END), ',') AS labels FROM m""")
def d14(spark, sf):
    return marked(spark, sf).select(*KEYS, joined(ops.completion_mask(F.col("ids"), RESP, INSTR)).alias("labels"))


@query("d15_pack", f"""WITH t AS (SELECT doc_id, unnest(list_append({sql_ids('text')}, 1)) AS id, generate_subscripts(list_append({sql_ids('text')}, 1), 1) AS k FROM documents),
  p AS (SELECT id, row_number() OVER (ORDER BY doc_id, k) - 1 AS place FROM t)
  SELECT (place // 256)::BIGINT AS chunk, string_agg(id, ',' ORDER BY place) AS input_ids FROM p GROUP BY place // 256 HAVING count(*) = 256""")
def d15(spark, sf):
    ids = text.token_ids(text.tokens("text"))
    out = ops.pack(documents(spark, sf).select("doc_id", "text"), "doc_id", ids, text.token_count("text"), 256, 1)
    return out.select("chunk", joined("input_ids").alias("input_ids"))


@query("d16_pack_buffered", f"""WITH RECURSIVE s AS (SELECT doc_id, doc_id // 500 AS shard, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS rn, length(text) AS chars,
  list_append({sql_ids('text')}, 1) AS ids FROM documents),
  b AS (SELECT shard, rn, 0::BIGINT AS buffer, chars AS held FROM s WHERE rn = 1 UNION ALL
  SELECT s.shard, s.rn, CASE WHEN held >= {256 * 3.6 * 64} THEN buffer + 1 ELSE buffer END, CASE WHEN held >= {256 * 3.6 * 64} THEN chars ELSE held + chars END
  FROM b JOIN s ON s.shard = b.shard AND s.rn = b.rn + 1),
  t AS (SELECT s.shard, b.buffer, doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS k FROM s JOIN b USING (shard, rn)),
  p AS (SELECT shard, buffer, id, row_number() OVER (PARTITION BY shard, buffer ORDER BY doc_id, k) - 1 AS place FROM t),
  c AS (SELECT shard, buffer, place // 256 AS chunk, string_agg(id, ',' ORDER BY place) AS input_ids FROM p GROUP BY ALL HAVING count(*) = 256)
  SELECT shard, buffer, chunk::BIGINT AS chunk, (row_number() OVER (PARTITION BY shard, buffer ORDER BY md5('42:' || chunk), chunk) - 1)::INT AS position, input_ids FROM c""")
def d16(spark, sf):
    ids = text.token_ids(text.tokens("text"))
    out = ops.pack_buffered(
        documents(spark, sf).select("doc_id", "text"), "doc_id", ids, text.token_count("text"), F.length("text"), 256, 1, 256 * 3.6 * 64,
        F.floor(F.col("doc_id") / 500),
    )
    return out.select("shard", "buffer", "chunk", "position", joined("input_ids").alias("input_ids"))


@query("d17_pack_plan", f"""SELECT round(sum(length(text)) / sum({sql_count(text.TOKEN)})::DOUBLE, 9) AS chars_per_token,
  round(sum(length(text)) / sum({sql_count(text.TOKEN)})::DOUBLE * 1024 * 1024, 3) AS buffer_chars FROM documents""")
def d17(spark, sf):
    out = ops.pack_plan(documents(spark, sf), "text", text.token_count("text"), 1024, 1024)
    return out.select(r9("chars_per_token").alias("chars_per_token"), F.round("buffer_chars", 3).alias("buffer_chars"))


@query("d18_best_of_n", """SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events
  QUALIFY rank <= 4""")
def d18(spark, sf):
    out = ops.best_of_n(load(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 4)
    return out.withColumn("rank", big("rank"))


@query("d19_length_draw", "SELECT doc_id, (8 + ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT % 24)::BIGINT AS length FROM documents")
def d19(spark, sf):
    return load(spark, sf, "documents").select("doc_id", big(ops.length_draw("doc_id", 8, 32)).alias("length"))


@query("d20_pad_batch", f"""WITH {TOKEN_TURNS}, n AS (SELECT *, max(len(response_ids)) OVER (PARTITION BY conv_id % 8) AS n FROM token_turns)
  SELECT conv_id, turn, array_to_string(list_resize(response_ids, n, 0), ',') AS ids, len(response_ids)::BIGINT AS attended FROM n""")
def d20(spark, sf):
    t = token_turns(spark, sf).withColumn("batch", F.col("conv_id") % 8)
    out = ops.pad_batch(t, "response_ids", ["batch"])
    return out.select(*KEYS, joined("response_ids").alias("ids"), big(F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x)).alias("attended"))
