"""Registered rollout statistic queries. Sequences are the lines of an order in date order."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import stats
from prefloom.functions.common import big, r6, r9 as rnd
from prefloom.functions.permute import sql_permuted
from prefloom.operators import rollout as ops
from prefloom.operators.ordering import collect_sequences, positions
from prefloom.plans.registry import load, query
from prefloom.plans.tables import TOKEN_TURNS, token_turns
from prefloom.session import keep

ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
         "l_returnflag", "l_linestatus"]
KEYS = ["seq_id", "batch"]


def rollouts(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_orderkey", *ORDER)
    seqs = collect_sequences(lines, "l_orderkey", ORDER)
    items = F.col("items")

    def each(fn):
        return F.transform(items, fn)

    half = F.floor(F.size(items) / 2).cast("int")
    return seqs.select(
        F.col("l_orderkey").alias("seq_id"), (F.col("l_orderkey") % 64).alias("batch"),
        each(lambda x: -x["l_discount"]).alias("logprobs"),
        each(lambda x: -x["l_tax"]).alias("ref_logprobs"),
        each(lambda x: -(x["l_discount"] + x["l_tax"]) / 2).alias("old_logprobs"),
        each(lambda x: stats.entropy(F.array(-x["l_discount"] * 10, -x["l_tax"] * 10))).alias("entropy"),
        each(lambda x: x["l_quantity"] / 47).alias("values"),
        each(lambda x: x["l_quantity"] / 47 + x["l_discount"] - x["l_tax"]).alias("vpreds"),
        each(lambda x: (x["l_returnflag"] != "R").cast("int")).alias("mask"),
        F.transform(F.slice(items, half + 1, F.size(items)), lambda x: x["l_extendedprice"] / 99991).alias("scores"),
    )


ROLL = f"""line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS rn FROM lineitem),
  tok0 AS (SELECT l_orderkey AS seq_id, l_orderkey % 64 AS batch, rn AS pos,
  count(*) OVER (PARTITION BY l_orderkey) AS t, -l_discount AS lp, -l_tax AS ref, -(l_discount + l_tax) / 2 AS old_lp,
  ln(exp(-l_discount * 10) + exp(-l_tax * 10)) + 10 * (l_discount * exp(-l_discount * 10) + l_tax * exp(-l_tax * 10)) / (exp(-l_discount * 10) + exp(-l_tax * 10)) AS ent,
  l_quantity / 47 AS value, l_quantity / 47 + l_discount - l_tax AS vpred, (l_returnflag <> 'R')::INT AS mask,
  l_extendedprice / 99991 AS price FROM line),
  tok1 AS (SELECT *, CASE WHEN pos >= t // 2 THEN price ELSE 0 END AS score, -0.2 * (lp - ref) AS nonscore FROM tok0),
  tok2 AS (SELECT *, nonscore + score AS rew, (nonscore + score) * mask AS mr, value * mask AS mv FROM tok1),
  tok3 AS (SELECT *, mr + coalesce(lead(mv) OVER s, 0) - mv AS delta FROM tok2 WINDOW s AS (PARTITION BY seq_id ORDER BY pos)),
  tok4 AS (SELECT a.seq_id, a.pos, sum(b.delta * pow(0.95::DOUBLE, b.pos - a.pos)) AS adv FROM tok3 a JOIN tok3 b
  ON a.seq_id = b.seq_id AND b.pos >= a.pos GROUP BY ALL),
  tok AS (SELECT tok3.*, adv, adv + mv AS ret FROM tok3 JOIN tok4 USING (seq_id, pos))"""
TOKSEL = "seq_id, batch, pos::BIGINT AS pos"


def long(df, column, keys=KEYS):
    out = df.select(*keys, F.posexplode(column).alias("pos", "x"))
    return out.select(*keys, big("pos").alias("pos"), rnd("x").alias("x"))


def rounded(df, keys):
    return df.select(*keys, *[rnd(f"`{c}`").alias(c.replace("/", "_")) for c in df.columns if c not in keys])


def tokens(spark, sf):
    """Long-form tokens with everything the losses need; advantages are whitened by batch."""
    kept = ["logprobs", "old_logprobs", "values", "vpreds", "advantages", "returns", "mask", "entropy"]
    df = ops.whiten_arrays(ops.advantages(rollouts(spark, sf)).select(*KEYS, *kept), "advantages", "mask", ["batch"], "white")
    names = ["white" if c == "advantages" else c for c in kept]
    long_form = ops.explode_tokens(df, KEYS, names)
    short = dict(zip(names, ["lp", "old_lp", "value", "vpred", "adv", "ret", "mask", "entropy"]))
    masked_value = F.col("value") * F.col("mask")
    return long_form.withColumnsRenamed(short).withColumn("value", masked_value)


WHITE = """fit AS (SELECT batch, avg(adv) FILTER (mask = 1) AS m, var_samp(adv) FILTER (mask = 1) AS v FROM tok GROUP BY batch),
  w AS (SELECT tok.* EXCLUDE (adv, value), mv AS value, (adv - m) / sqrt(v + 1e-8) AS adv FROM tok JOIN fit USING (batch))"""
LOSS = f"""WITH {ROLL}, {WHITE}, e AS (SELECT *, greatest(least(vpred, value + 0.2), value - 0.2) AS vc, exp(lp - old_lp) AS r FROM w),
  f AS (SELECT *, (vpred - ret) ** 2 AS e1, (vc - ret) ** 2 AS e2, -adv * r AS p1, -adv * greatest(least(r, 1.2), 0.8) AS p2 FROM e WHERE mask = 1)"""


@query("r1_logprob", """WITH z AS (SELECT vec_id, embedding, label, list_max(embedding)::DOUBLE AS m FROM embeddings),
  s AS (SELECT vec_id, embedding[label + 1]::DOUBLE - m - ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - m)))) AS lp FROM z)
  SELECT vec_id, round(lp, 9) AS logprob FROM s""")
def r1(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", rnd(stats.logprob(F.col("e"), F.col("label"))).alias("logprob"))


@query("r1_log_softmax", """WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
  SELECT vec_id, pos::BIGINT AS pos, round(x - ln(sum(exp(x)) OVER (PARTITION BY vec_id)), 9) AS x FROM z""")
def r1b(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return long(e.withColumn("lp", stats.log_softmax(F.col("e"))), "lp", ["vec_id"])


@query("r2_entropy", """WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), n AS (SELECT vec_id, ln(sum(exp(x))) AS z FROM z GROUP BY vec_id)
  SELECT vec_id, round(any_value(n.z) - sum(exp(x - n.z) * x), 9) AS entropy FROM z JOIN n USING (vec_id) GROUP BY vec_id""")
def r2(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return e.select("vec_id", rnd(stats.entropy(F.col("e"))).alias("entropy"))


@query("r3_response_mask", f"""WITH {TOKEN_TURNS}, b AS (SELECT conv_id, turn, len(query_ids) AS q, len(response_ids) AS r, conv_id % 8 AS batch FROM token_turns),
  c AS (SELECT *, max(q) OVER (PARTITION BY batch) - q AS pad FROM b), p AS (SELECT *, unnest(range(0, pad + q + r - 1)) AS pos FROM c)
  SELECT conv_id, turn, pos::BIGINT AS pos, (pos >= pad + q - 1 AND pos < pad + q - 1 + r)::BIGINT AS decoder,
  (pos >= 1 AND pos < q + r - 1 AND pos + 1 >= pad)::BIGINT AS encoder_decoder FROM p""")
def r3(spark, sf):
    """Queries and responses of the conversations, queries padded on the left to the longest of their batch."""
    t = token_turns(spark, sf).select("conv_id", "turn", F.size("query_ids").alias("q"), F.size("response_ids").alias("r"), (F.col("conv_id") % 8).alias("batch"))
    widest = t.groupBy("batch").agg(F.max("q").alias("width"))
    pad, both = F.col("width") - F.col("q"), F.col("q") + F.col("r")
    m = t.join(widest, "batch").withColumn("a", F.concat(F.array_repeat(F.lit(0), pad), F.array_repeat(F.lit(1), both)))
    m = m.select(
        "conv_id", "turn", stats.response_mask(F.col("a"), False, F.col("q"), F.col("r")).alias("d"),
        stats.response_mask(F.col("a"), True).alias("e"),
    )
    out = m.select("conv_id", "turn", F.posexplode(F.arrays_zip("d", "e")).alias("pos", "m"))
    return out.select("conv_id", "turn", big("pos").alias("pos"), big("m.d").alias("decoder"), big("m.e").alias("encoder_decoder"))


for _id, _kind, _sql in [("r4", "kl", "lp - ref"), ("r5", "abs", "abs(lp - ref)"), ("r6", "mse", "0.5 * (lp - ref) ** 2")]:
    def _kl(spark, sf, kind=_kind):
        p = F.zip_with("logprobs", "ref_logprobs", lambda a, b: stats.kl_penalty(a, b, kind))
        return long(rollouts(spark, sf).withColumn("kl", p), "kl")

    query(f"{_id}_kl_penalty_{_kind}", f"WITH {ROLL} SELECT {TOKSEL}, round({_sql}, 9) AS x FROM tok1")(_kl)


@query("r7_kl_penalty_full", """WITH z AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(list_reverse(embedding))::DOUBLE AS y FROM embeddings),
  n AS (SELECT vec_id, ln(sum(exp(x))) AS z FROM z GROUP BY vec_id)
  SELECT vec_id, round(sum(exp(x - n.z) * (x - y)), 9) AS kl FROM z JOIN n USING (vec_id) GROUP BY vec_id""")
def r7(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    e = e.withColumn("p", stats.log_softmax(F.col("e"))).withColumn("q", stats.log_softmax(F.reverse("e")))
    return e.select("vec_id", rnd(stats.kl_penalty(F.col("p"), F.col("q"), "full")).alias("kl"))


@query("r8_token_rewards", f"WITH {ROLL} SELECT {TOKSEL}, round(rew, 9) AS x FROM tok2")
def r8(spark, sf):
    return long(ops.advantages(rollouts(spark, sf)), "rewards")


@query("r9_gae", f"WITH {ROLL} SELECT {TOKSEL}, round(adv, 9) AS x FROM tok")
def r9(spark, sf):
    return long(ops.advantages(rollouts(spark, sf)), "advantages")


@query("r10_returns", f"WITH {ROLL} SELECT {TOKSEL}, round(ret, 9) AS x FROM tok")
def r10(spark, sf):
    return long(ops.advantages(rollouts(spark, sf)), "returns")


@query("r11_masked_whiten", f"WITH {ROLL}, {WHITE} SELECT {TOKSEL}, round(adv, 9) AS x FROM w")
def r11(spark, sf):
    needed = ops.advantages(rollouts(spark, sf)).select(*KEYS, "advantages", "mask")
    return long(ops.whiten_arrays(needed, "advantages", "mask", ["batch"], "white"), "white")


@query("r12_whiten", """SELECT event_id, round((value - avg(value) OVER ()) / sqrt(var_samp(value) OVER () + 1e-8), 6) AS whitened,
  round((value - avg(value) OVER ()) / sqrt(var_samp(value) OVER () + 1e-8) + avg(value) OVER (), 6) AS unshifted FROM events""")
def r12(spark, sf):
    ev = load(spark, sf, "events").select("event_id", "value")
    out = ops.whiten(ops.whiten(ev, "value"), "value", shift=False, out="unshifted")
    return out.select("event_id", r6("whitened").alias("whitened"), r6("unshifted").alias("unshifted"))


@query("r13_masked_mean", f"""WITH {ROLL}, s AS (SELECT seq_id::VARCHAR AS who, 'sequence' AS axis, sum(value * mask) / nullif(sum(mask), 0) AS mean FROM tok1 GROUP BY seq_id
  UNION ALL SELECT pos::VARCHAR, 'position', sum(value * mask) / nullif(sum(mask), 0) FROM tok1 GROUP BY pos
  UNION ALL SELECT 'all', 'all', sum(value * mask) / nullif(sum(mask), 0) FROM tok1) SELECT who, axis, round(mean, 9) AS mean FROM s""")
def r13(spark, sf):
    t = ops.explode_tokens(rollouts(spark, sf), KEYS, ["values", "mask"])
    out = ops.masked_means(t, "values", "mask", [["seq_id"], ["pos"], []])
    axis = F.when(F.col("by") == "seq_id", "sequence").when(F.col("by") == "pos", "position").otherwise("all")
    return out.select(F.coalesce(F.col("seq_id").cast("string"), F.col("pos").cast("string"), F.lit("all")).alias("who"), axis.alias("axis"), rnd("mean").alias("mean"))


@query("r14_masked_var", f"""WITH {ROLL} SELECT batch, round(var_samp(value) FILTER (mask = 1), 9) AS var, round(var_pop(value) FILTER (mask = 1), 9) AS biased
  FROM tok1 GROUP BY batch""")
def r14(spark, sf):
    t = ops.explode_tokens(rollouts(spark, sf), KEYS, ["values", "mask"])
    out = ops.masked_var(t, "values", "mask", ["batch"])
    return out.select("batch", rnd("var").alias("var"), rnd("biased").alias("biased"))


@query("r15_clip", f"WITH {ROLL} SELECT {TOKSEL}, round(greatest(least(vpred, value + 0.05), value - 0.05), 9) AS x FROM tok1")
def r15(spark, sf):
    clipped = F.zip_with("vpreds", "values", lambda p, v: stats.clip(p, v - 0.05, v + 0.05))
    return long(rollouts(spark, sf).withColumn("c", clipped), "c")


LOSS_COLUMNS = {
    "r16_value_loss": ["loss/value", "val/clipfrac"],
    "r17_policy_loss": ["loss/policy", "policy/clipfrac"],
    "r19_policy_stats": ["policy/approxkl", "policy/policykl", "policy/entropy"],
    "r20_train_stats": ["loss/policy", "loss/value", "loss/total", "policy/approxkl", "policy/policykl", "policy/clipfrac",
                        "policy/advantages_mean", "policy/ratio_mean", "returns/mean", "returns/var", "val/vpred", "val/error",
                        "val/clipfrac", "val/mean", "val/var", "policy/entropy"],
    "r23_var_explained": ["val/error", "returns/var", "val/var_explained"],
}
LOSS_SQL = {
    "loss/policy": "avg(greatest(p1, p2))", "loss/value": "0.5 * avg(greatest(e1, e2))",
    "loss/total": "avg(greatest(p1, p2)) + 0.1 * 0.5 * avg(greatest(e1, e2))",
    "policy/approxkl": "avg(0.5 * (lp - old_lp) ** 2)", "policy/policykl": "avg(old_lp - lp)",
    "policy/clipfrac": "avg((p2 > p1)::INT)", "policy/advantages_mean": "avg(adv)", "policy/ratio_mean": "avg(r)",
    "returns/mean": "avg(ret)", "returns/var": "var_samp(ret)", "val/vpred": "avg(vpred)", "val/error": "avg(e1)",
    "val/clipfrac": "avg((e2 > e1)::INT)", "val/mean": "avg(value)", "policy/entropy": "avg(ent)", "val/var": "var_samp(value)",
    "val/var_explained": "1 - avg(e1) / var_samp(ret)",
}


def loss_sql(names, prefix=""):
    return ", ".join(f"round({LOSS_SQL[n]}, 9) + 0.0 AS {prefix}{n.replace('/', '_')}" for n in names)


for _name, _columns in LOSS_COLUMNS.items():
    def _loss(spark, sf, names=_columns):
        return rounded(ops.train_stats(tokens(spark, sf)).select("batch", *[f"`{n}`" for n in names]), ["batch"])

    query(_name, f"{LOSS} SELECT batch, {loss_sql(_columns)} FROM f GROUP BY batch")(_loss)


@query("r18_ratio_guard", f"""{LOSS}, g AS (SELECT batch, avg(r) AS ar, {loss_sql(['loss/policy', 'loss/value', 'loss/total'])} FROM f GROUP BY batch)
  SELECT batch, CASE WHEN ar > 1.0 THEN 0.0 ELSE loss_policy END AS loss_policy, CASE WHEN ar > 1.0 THEN 0.0 ELSE loss_value END AS loss_value,
  CASE WHEN ar > 1.0 THEN 0.0 ELSE loss_total END AS loss_total FROM g""")
def r18(spark, sf):
    out = ops.train_stats(tokens(spark, sf), ratio_threshold=1.0)
    return rounded(out.select("batch", "`loss/policy`", "`loss/value`", "`loss/total`"), ["batch"])


@query("r21_step_stats", f"""WITH {ROLL}, s AS (SELECT seq_id, batch, sum((lp - ref) * mask) AS kl, sum(-lp * mask) AS ent, sum(mask) AS n,
  avg(price) FILTER (pos >= t // 2) AS sc FROM tok1 GROUP BY ALL)
  SELECT batch, round(avg(kl), 9) + 0.0 AS objective_kl, round(avg(ent), 9) AS objective_entropy, round(-0.2 * sum(kl) / sum(n), 9) + 0.0 AS ppo_mean_non_score_reward,
  round(avg(sc), 9) AS ppo_mean_scores, round(stddev_samp(sc), 9) AS ppo_std_scores FROM s GROUP BY batch""")
def r21(spark, sf):
    return rounded(ops.step_stats(rollouts(spark, sf)), ["batch"])


@query("r22_length_stats", f"""WITH {ROLL}, s AS (SELECT batch, seq_id, count(*) AS n, count(*) FILTER (pos >= t // 2) AS k FROM tok1 GROUP BY ALL)
  SELECT batch, round(avg(n), 9) AS logprobs_len_mean, round(stddev_samp(n), 9) AS logprobs_len_std, round(avg(k), 9) AS scores_len_mean,
  round(stddev_samp(k), 9) AS scores_len_std FROM s GROUP BY batch""")
def r22(spark, sf):
    return rounded(ops.length_stats(rollouts(spark, sf), ["logprobs", "scores"], ["batch"]), ["batch"])


@query("r22_length_dist", f"WITH {ROLL}, s AS (SELECT seq_id, count(*) AS length FROM tok1 GROUP BY ALL) SELECT length, count(*) AS count FROM s GROUP BY length")
def r22b(spark, sf):
    return ops.length_dist(rollouts(spark, sf), "logprobs")


SHARES = [0.1, 0.25, 0.5, 0.75, 0.9]


@query("r22_length_quantiles", f"""WITH {ROLL}, s AS (SELECT batch, seq_id, count(*) AS n, count(*) FILTER (pos >= t // 2) AS k FROM tok1 GROUP BY ALL),
  q AS (SELECT batch, 'logprobs' AS value, quantile_disc(n, {SHARES}) AS q FROM s GROUP BY batch UNION ALL SELECT batch, 'scores', quantile_disc(k, {SHARES}) FROM s GROUP BY batch)
  SELECT batch, value, unnest({SHARES})::DOUBLE AS share, unnest(q)::DOUBLE AS quantile FROM q""")
def r22c(spark, sf):
    return ops.quantiles(rollouts(spark, sf), {c: F.size(c) for c in ("logprobs", "scores")}, SHARES, ["batch"])


@query("r24_reward_quantiles", f"""WITH {ROLL}, s AS (SELECT batch, seq_id, sum(score) AS r FROM tok1 GROUP BY ALL), q AS (SELECT batch, quantile_disc(r, {SHARES}) AS q FROM s GROUP BY batch)
  SELECT batch, unnest({SHARES})::DOUBLE AS share, round(unnest(q), 9) AS quantile FROM q""")
def r24c(spark, sf):
    rows = ops.env_rewards(rollouts(spark, sf), "scores", ["batch"])
    return ops.quantiles(rows, {"reward": F.col("reward")}, SHARES, ["batch"]).select("batch", "share", rnd("quantile").alias("quantile"))


@query("r24_env_reward_stats", f"""WITH {ROLL}, s AS (SELECT batch, seq_id, sum(score) AS r FROM tok1 GROUP BY ALL)
  SELECT batch, round(avg(r), 9) AS env_reward_mean, round(stddev_samp(r), 9) AS env_reward_std FROM s GROUP BY batch""")
def r24(spark, sf):
    return rounded(ops.env_reward_stats(rollouts(spark, sf), "scores", ["batch"]), ["batch"])


@query("r24_reward_values", f"WITH {ROLL} SELECT batch, seq_id, round(sum(score), 9) AS reward FROM tok1 GROUP BY batch, seq_id")
def r24b(spark, sf):
    return ops.env_rewards(rollouts(spark, sf), "scores", ["batch", "seq_id"]).withColumn("reward", rnd("reward"))


@query("r21_sequence_kl", f"WITH {ROLL} SELECT batch, seq_id, round(sum((lp - ref) * mask), 9) + 0.0 AS kl FROM tok1 GROUP BY batch, seq_id")
def r21b(spark, sf):
    return ops.sequence_kl(rollouts(spark, sf), ["batch", "seq_id"]).withColumn("kl", rnd("kl"))


def step_log(spark, sf):
    """orders as a step log: run = priority, kl from the price, steps in date order."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", F.col("o_orderpriority").alias("run"))
    return o.withColumn("kl", F.col("o_totalprice") / 40000).withColumn("n_steps", F.lit(32))


STEP_ORDER = ["o_orderdate", "o_orderkey"]


@query("r25_kl_coef", """WITH m AS (SELECT o_orderkey, o_orderdate, o_orderpriority AS run, 1 + greatest(least(o_totalprice / 40000 / 6.0 - 1, 0.2), -0.2) * 32 / 10000 AS f FROM orders)
  SELECT o_orderkey, run, round(0.2 * exp(sum(ln(f)) OVER (PARTITION BY run ORDER BY o_orderdate, o_orderkey)), 9) AS kl_coef FROM m""")
def r25(spark, sf):
    out = ops.kl_coef(step_log(spark, sf), STEP_ORDER)
    return out.select("o_orderkey", "run", rnd("kl_coef").alias("kl_coef"))


def epoch_log(spark, sf):
    """lineitem as mini-batch statistics: step = part, epoch and mini batch from supplier and line."""
    return load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("step"), (F.col("l_suppkey") % 4).alias("epoch"), F.col("l_linenumber").alias("mini_batch"),
        (F.col("l_discount") - F.col("l_tax") + 0.05).alias("policykl"),
    )


@query("r26_early_stop", """WITH b AS (SELECT l_partkey AS step, l_suppkey % 4 AS epoch, l_linenumber AS mb, l_discount - l_tax + 0.05 AS k FROM lineitem),
  l AS (SELECT step, epoch, max(mb) AS mb FROM b GROUP BY ALL), o AS (SELECT step, epoch, avg(k) AS k FROM b JOIN l USING (step, epoch, mb) GROUP BY ALL),
  s AS (SELECT step, min(epoch) AS stop FROM o WHERE k > 1.5 * 0.061 GROUP BY step)
  SELECT step, epoch, count(*) AS kept FROM b LEFT JOIN s USING (step) WHERE stop IS NULL OR epoch <= stop GROUP BY step, epoch""")
def r26(spark, sf):
    kept = ops.early_stop(epoch_log(spark, sf), 0.061)
    return kept.groupBy("step", "epoch").agg(F.count(F.lit(1)).alias("kept"))


@query("r27_best_so_far", """WITH b AS (SELECT o_orderkey, o_orderpriority AS run, o_totalprice, max(o_totalprice) OVER w AS before,
  FROM orders WHERE o_orderkey % 3 = 0 WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT o_orderkey, run, greatest(before, o_totalprice) AS best, (before IS NULL OR o_totalprice > before) AS improved FROM b""")
def r27(spark, sf):
    out = ops.best_so_far(step_log(spark, sf), "o_totalprice", STEP_ORDER, ["run"], "o_orderkey", 3)
    return out.select("o_orderkey", "run", "best", "improved")


@query("r28_minibatches", f"""WITH RECURSIVE e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS n, unnest(range(0, 4)) AS epoch FROM embeddings),
  {sql_permuted("e", "vec_id, epoch", "place", "n", "'42:' || epoch")}
  SELECT vec_id, epoch::BIGINT AS epoch, x::BIGINT AS position, (x // 32)::BIGINT AS backward_batch, ((x % 32) // 16)::BIGINT AS mini_batch FROM permuted""")
def r28(spark, sf):
    rows = keep(positions(load(spark, sf, "embeddings").select("vec_id"), ["vec_id"], out="place"), "places")
    out = ops.minibatches(rows, "place", rows.count(), 4, 32, 16).drop("place")
    return out.withColumn("epoch", big("epoch"))


@query("r29_array_mean", """WITH z AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
  SELECT label::BIGINT AS label, pos::BIGINT AS pos, round(avg(x), 9) + 0.0 AS x FROM z GROUP BY label, pos""")
def r29(spark, sf):
    e = load(spark, sf, "embeddings").select(big("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return long(ops.array_mean(e, "embedding", ["label"]), "embedding", ["label"])


@query("r30_stack_ragged", f"""WITH {ROLL}, n AS (SELECT max(t) AS n FROM tok1), s AS (SELECT DISTINCT seq_id, batch FROM tok1),
  g AS (SELECT s.*, unnest(range(0, n)) AS pos FROM s, n)
  SELECT g.seq_id, g.batch, g.pos::BIGINT AS pos, round(coalesce(CASE WHEN value > 0.9 THEN -1.0 ELSE value END, -1.0), 9) AS x
  FROM g LEFT JOIN tok1 ON g.seq_id = tok1.seq_id AND g.pos = tok1.pos""")
def r30(spark, sf):
    with_nan = F.transform("values", lambda v: F.when(v > 0.9, F.lit(float("nan"))).otherwise(v))
    return long(ops.stack_ragged(rollouts(spark, sf).withColumn("values", with_nan), "values"), "values")


@query("r31_flatten_struct", """SELECT batch, n AS "stats/size/n_mean", round(v, 9) AS "stats/value_mean", n AS only_mean FROM (SELECT l_orderkey % 64 AS batch, count(*) AS n, avg(l_quantity) AS v
  FROM lineitem GROUP BY ALL)""")
def r31(spark, sf):
    li = load(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 64).alias("batch")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("l_quantity")).alias("v"))
    nested = li.select("batch", F.struct(F.struct("n").alias("size"), F.col("v").alias("value")).alias("stats"), F.array("n").alias("only"))
    flat = ops.single_to_scalar(ops.flatten_struct(nested, suffix="_mean"), ["only_mean"])
    return flat.withColumnRenamed("batch_mean", "batch")


@query("r32_worker_mean", """WITH w AS (SELECT event_type, user_id % 8 AS worker, avg(value) AS m FROM events GROUP BY ALL)
  SELECT event_type, round(avg(m), 9) AS value FROM w GROUP BY event_type""")
def r32(spark, sf):
    ev = load(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 8).alias("worker"))
    out = ops.worker_mean(ev, ["value"], "worker", ["event_type"])
    return out.withColumn("value", rnd("value"))


@query("r33_step_train_stats", f"""{LOSS}, b AS (SELECT batch, {', '.join(f"{LOSS_SQL[n]} AS {n.replace('/', '_')}" for n in LOSS_COLUMNS['r20_train_stats'])} FROM f GROUP BY batch)
  SELECT batch % 4 AS step, {', '.join(f"round(avg({n.replace('/', '_')}), 9) + 0.0 AS ppo_{n.replace('/', '_')}" for n in LOSS_COLUMNS['r20_train_stats'])} FROM b GROUP BY step""")
def r33(spark, sf):
    st = ops.train_stats(tokens(spark, sf)).drop("val/var_explained").withColumn("step", F.col("batch") % 4)
    return rounded(ops.step_train_stats(st, "step"), ["step"])
