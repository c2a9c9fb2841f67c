"""Registered dataset preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.functions.common import big
from prefloom.functions.permute import sql_permuted
from prefloom.operators import prep
from prefloom.operators.ordering import positions
from prefloom.plans.registry import load, query
from prefloom.plans.tables import EOS, RUNS, TOKEN_TURNS, TURNS, documents, runs, sq, sql_ids, token_turns, turns
from prefloom.operators.compare import shared_sample
from prefloom.session import keep

SHARE = "('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("p1_first_n", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 1000")
def p1(spark, sf):
    return prep.first_n(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), 1000,
                        ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey")


@query("p2_split", f"""SELECT doc_id, CASE WHEN {SHARE.format(seed=42, key='doc_id')} < 0.3 THEN 'test'
  WHEN {SHARE.format(seed=43, key='doc_id')} < 0.1 THEN 'eval' ELSE 'train' END AS part FROM documents""")
def p2(spark, sf):
    return prep.split(load(spark, sf, "documents").select("doc_id"), "doc_id")


@query("p2_split_exact", """WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r,
  count(*) OVER () AS n FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5('43:' || doc_id), doc_id) AS r,
  count(*) OVER () AS n FROM a WHERE r > ceil(n * 0.3))
  SELECT doc_id, 'test' AS part FROM a WHERE r <= ceil(n * 0.3) UNION ALL
  SELECT doc_id, CASE WHEN r <= ceil(n * 0.1) THEN 'eval' ELSE 'train' END FROM b""")
def p2x(spark, sf):
    return prep.split_exact(load(spark, sf, "documents").select("doc_id"), "doc_id")


@query("p3_floor_to_multiple", """WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx,
  count(*) OVER () AS n FROM orders) SELECT o_orderkey, idx::BIGINT AS idx FROM i WHERE idx < n // 64 * 64""")
def p3(spark, sf):
    orders = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    ranked = positions(orders, ["o_orderdate", "o_orderkey"])
    return prep.floor_to_multiple(ranked, 64).select("o_orderkey", "idx")


@query("p4_shuffle", """SELECT doc_id, (row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1)::BIGINT AS position
  FROM documents""")
def p4(spark, sf):
    return prep.shuffle(load(spark, sf, "documents").select("doc_id"), "doc_id").orderBy("position")


@query("p4_shuffle_places", f"""WITH RECURSIVE {RUNS}, c AS (SELECT run, count(*) AS n FROM runs GROUP BY run), z AS (SELECT run, idx, n FROM runs JOIN c USING (run)),
  {sql_permuted("z", "run, idx", "idx", "n", "'42:' || run")} SELECT run, idx::BIGINT AS idx, x::BIGINT AS position FROM permuted""")
def p4b(spark, sf):
    rows = runs(spark, sf).select("run", "idx")
    sized = rows.join(rows.groupBy("run").agg(F.count(F.lit(1)).alias("n")), "run")
    return prep.shuffle_places(sized, "idx", F.col("n"), F.concat(F.lit("42:"), "run")).select("run", "idx", "position")


@query("p2_split_places", f"""WITH RECURSIVE z AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
  {sql_permuted("z", "doc_id", "place", "n", "42")}, m AS (SELECT max(n) AS n, ceil(max(n) * 0.3) AS t FROM z)
  SELECT doc_id, CASE WHEN x < t THEN 'test' WHEN x < t + ceil((m.n - t) * 0.1) THEN 'eval' ELSE 'train' END AS part FROM permuted, m""")
def p2b(spark, sf):
    rows = keep(positions(load(spark, sf, "documents").select("doc_id"), ["doc_id"], out="place"), "places")
    return prep.split_places(rows, "place", rows.count()).select("doc_id", "part")


@query("p5_shared_sample", f"""WITH {RUNS}, c AS (SELECT idx FROM runs GROUP BY idx
  HAVING count(DISTINCT run) = (SELECT count(DISTINCT run) FROM runs) ORDER BY md5('42:' || idx), idx LIMIT 20)
  SELECT run, idx, doc_id FROM runs WHERE idx IN (SELECT idx FROM c)""")
def p5(spark, sf):
    return shared_sample(runs(spark, sf), 20, 42).select("run", "idx", "doc_id")


@query("p6_with_prefix", "SELECT doc_id, 'translate Spanish to English: ' || text AS prompt FROM documents WHERE lang = 'es'")
def p6(spark, sf):
    es = load(spark, sf, "documents").filter("lang = 'es'")
    return prep.with_prefix(es, "text", "translate Spanish to English: ").select("doc_id", "prompt")


TEMPLATE = "Human: {instruction}\n\nAssistant: {completion}\n(asked: {instruction})"


@query("p7_fill_template", f"""WITH {TURNS} SELECT conv_id, turn, replace(replace({sq(TEMPLATE)}, '{{instruction}}',
  query || ' {{completion}}'), '{{completion}}', response) AS filled FROM turns""")
def p7(spark, sf):
    filled = text.fill_template(
        F.lit(TEMPLATE), {"instruction": F.concat("query", F.lit(" {completion}")), "completion": F.col("response")}
    )
    return turns(spark, sf).select("conv_id", "turn", filled.alias("filled"))


SQL_SENT = f"list_filter(regexp_extract_all(response, {sq(text.SENTENCE)}), lambda p: regexp_replace(p, '\\s+', '', 'g') <> '')"


@query("p8_reward_input", f"""WITH {TURNS}, s AS (SELECT *, array_to_string(list_transform({SQL_SENT}, lambda p: '</s> ' || p), ' ') AS seg
  FROM turns) SELECT conv_id, turn, trim(regexp_replace(query, '\\s+', ' ', 'g')) || ' answer: ' || response AS completeness,
  'question: ' || query || ' answer: ' || seg AS verbosity, query || ' answer: ' || seg AS factuality FROM s""")
def p8(spark, sf):
    segments = F.transform(text.sentence_spans("response"), lambda s: s["text"])
    body = {"completeness": F.col("response"), "verbosity": segments, "factuality": segments}
    return turns(spark, sf).select(
        "conv_id", "turn", *[prep.reward_input(k, F.col("query"), b).alias(k) for k, b in body.items()]
    )


@query("p9_flag_short", f"WITH {TOKEN_TURNS} SELECT conv_id, turn, len(response_ids) <= 12 AS too_short FROM token_turns")
def p9(spark, sf):
    return token_turns(spark, sf).select("conv_id", "turn", prep.is_short(F.col("response_ids"), 12).alias("too_short"))


@query("p10_keep_columns", f"WITH {TURNS} SELECT query, response, turn FROM turns")
def p10(spark, sf):
    return prep.keep_columns(turns(spark, sf), ["turn", "input_ids"])


@query("p11_cut_at_eos", f"""WITH {TOKEN_TURNS}, c AS (SELECT *, coalesce(list_position(response_ids, {EOS}) - 1, len(response_ids)) AS n
  FROM token_turns) SELECT conv_id, turn, n::BIGINT AS length_before_eos, array_to_string(response_ids[1:n + 1], ',') AS kept,
  array_to_string(response_ids[1:n], ',') AS dropped FROM c""")
def p11(spark, sf):
    r = F.col("response_ids")
    return token_turns(spark, sf).select(
        "conv_id", "turn", big(prep.length_before(r, EOS)).alias("length_before_eos"),
        joined(prep.cut_at_eos(r, EOS, True)).alias("kept"), joined(prep.cut_at_eos(r, EOS, False)).alias("dropped"),
    )


LONGEST = "(SELECT max(len(response_ids)) FROM token_turns)"


def padded_turns(spark, sf):
    """Answers padded to the longest of the table."""
    t = token_turns(spark, sf)
    return t.withColumn("p", prep.pad_response(F.col("response_ids"), t.agg(F.max(F.size("response_ids"))).scalar()))


@query("p12_pad_response", f"""WITH {TOKEN_TURNS}, p AS (SELECT conv_id, turn,
  list_resize(response_ids[2:], {LONGEST} - 1, 0) AS ids FROM token_turns) SELECT conv_id, turn, array_to_string(ids, ',') AS padded,
  array_to_string(list_transform(ids, lambda t: (t <> 0)::INT), ',') AS mask FROM p""")
def p12(spark, sf):
    padded = padded_turns(spark, sf)
    return padded.select("conv_id", "turn", joined("p").alias("padded"), joined(prep.attention(F.col("p"))).alias("mask"))


@query("p13_mask_pad", f"""WITH {TOKEN_TURNS}, p AS (SELECT conv_id, turn, list_resize(response_ids[2:], {LONGEST} - 1, 0) AS ids FROM token_turns)
  SELECT conv_id, turn, array_to_string(list_transform(ids, lambda t: CASE WHEN t = 0 THEN -100 ELSE t END), ',') AS labels,
  array_to_string(ids, ',') AS restored FROM p""")
def p13(spark, sf):
    padded = padded_turns(spark, sf).withColumn("p", prep.swap_id(F.col("p"), 0, -100))
    return padded.select(
        "conv_id", "turn", joined("p").alias("labels"), joined(prep.swap_id(F.col("p"), -100, 0)).alias("restored")
    )


@query("p14_validate_rollouts", f"""WITH {TOKEN_TURNS}, t AS (SELECT *, conv_id % 8 AS batch FROM token_turns)
  SELECT conv_id || '/' || turn AS "where", 'response_ids and query_ids differ in length' AS problem FROM t
  WHERE len(response_ids) <> len(query_ids) UNION ALL
  SELECT batch::VARCHAR, 'batch has ' || count(*) || ' rows instead of 32' FROM t GROUP BY batch HAVING count(*) <> 32""")
def p14(spark, sf):
    t = token_turns(spark, sf).withColumn("batch", F.col("conv_id") % 8)
    t = t.withColumn("id", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return prep.validate_rollouts(t, "id", 32, ["query_ids", "response_ids"])


@query("p15_tokenize", f"""SELECT doc_id, array_to_string(({sql_ids('text')})[1:512], ',') AS input_ids,
  least(len(regexp_extract_all(text, {sq(text.TOKEN)})), 512)::BIGINT AS n FROM documents""")
def p15(spark, sf):
    out = prep.tokenize(documents(spark, sf).select("doc_id", "text"), "text", 512)
    return out.select("doc_id", joined("input_ids").alias("input_ids"), big(F.size("attention_mask")).alias("n"))


@query("p16_postprocess", f"""WITH {TURNS} SELECT conv_id, turn, regexp_replace(regexp_replace(query, '^\\s+', ''), '\\s+$', '') AS query,
  regexp_replace(regexp_replace(response, '^\\s+', ''), '\\s+$', '') AS reference, 1::BIGINT AS n FROM turns""")
def p16(spark, sf):
    out = prep.postprocess(turns(spark, sf), "query", "response")
    return out.select("conv_id", "turn", "query", F.get("response", F.lit(0)).alias("reference"), big(F.size("response")).alias("n"))


@query("p17_strip_prompt", f"WITH {TOKEN_TURNS} SELECT conv_id, turn, array_to_string(response_ids, ',') AS response FROM token_turns")
def p17(spark, sf):
    pads = F.array_repeat(F.lit(0), (F.col("conv_id") % 5).cast("int"))
    t = token_turns(spark, sf).select(
        "conv_id", "turn", F.concat(pads, "query_ids", "response_ids").alias("generated"),
        F.concat(pads, prep.ones(F.size("query_ids"))).alias("mask"),
    )
    return t.select("conv_id", "turn", joined(prep.strip_prompt(F.col("generated"), F.col("mask"))).alias("response"))


@query("p18_assemble_decoder", f"""WITH {TOKEN_TURNS}, j AS (SELECT conv_id, turn, conv_id % 8 AS batch,
  list_concat(query_ids, response_ids) AS ids FROM token_turns), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS n FROM j)
  SELECT conv_id, turn, array_to_string(list_resize(ids, n, 0), ',') AS input_ids,
  array_to_string(list_resize(list_transform(ids, lambda t: 1), n, 0), ',') AS attention_mask FROM m""")
def p18(spark, sf):
    t = token_turns(spark, sf).withColumn("batch", F.col("conv_id") % 8)
    out = prep.collate(prep.assemble(t, False), ["batch"], {"input_ids": (0, "right"), "attention_mask": (0, "right")})
    return out.select("conv_id", "turn", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


def sql_padded(array: str, n: str, out: str) -> str:
    return f"array_to_string(list_resize({array}, {n}, 0), ',') AS {out}"


@query("p18_assemble_encoder_decoder", f"""WITH {TOKEN_TURNS}, m AS (SELECT *, max(len(query_ids)) OVER (PARTITION BY conv_id % 8) AS n,
  max(len(response_ids)) OVER (PARTITION BY conv_id % 8) AS k FROM token_turns)
  SELECT conv_id, turn, {sql_padded('query_ids', 'n', 'input_ids')}, {sql_padded('list_transform(query_ids, lambda t: 1)', 'n', 'attention_mask')},
  {sql_padded('response_ids', 'k', 'decoder_input_ids')}, {sql_padded('list_transform(response_ids, lambda t: 1)', 'k', 'decoder_attention_mask')} FROM m""")
def p18e(spark, sf):
    t = token_turns(spark, sf).withColumn("batch", F.col("conv_id") % 8)
    names = ["input_ids", "attention_mask", "decoder_input_ids", "decoder_attention_mask"]
    out = prep.collate(prep.assemble(t, True), ["batch"], {c: (0, "right") for c in names})
    return out.select("conv_id", "turn", *[joined(c).alias(c) for c in names])
