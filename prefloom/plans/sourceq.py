"""Registered source, sink, stream and model queries.

Files are derived from the given tables, written to the shared scratch folder and read back.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.functions.common import big, r6
from prefloom.operators import compare as cmp
from prefloom.operators import models, textops
from prefloom.operators import requests as reqops
from prefloom.operators.ordering import positions
from prefloom.plans.compare import BASE
from prefloom.plans.registry import load, query
from prefloom.plans.requestq import COOL, JUDGED, LOG, STATUS, attempt_log, judged_pairs
from prefloom.plans.tables import METRICS, RUNS, TURNS, documents, runs, sq, sql_count, sql_ids, turns
from prefloom.plans.textq import JUDGE_SYSTEM, JUDGE_USER
from prefloom.session import keep, scratch
from prefloom.sources import files
from prefloom.streaming import streams


@query("s1_read_qa", f"WITH {TURNS} SELECT query AS prompt, query AS question, to_json([response])::VARCHAR AS refs FROM turns")
def s1(spark, sf):
    folder = scratch(spark, "qa")
    t = turns(spark, sf).select(F.col("query").alias("text"), F.col("query").alias("question"), F.array("response").alias("answer"), F.array("response").alias("passages"))
    files.write_json_arrays(t, f"{folder}/train.json")
    return files.read_qa(spark, folder, "train").select("prompt", "metadata.question", F.col("metadata.references").alias("refs"))


@query("s2_read_parallel", """WITH es AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE lang = 'es'),
  en AS (SELECT text, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents WHERE lang = 'en')
  SELECT es.text AS es, en.text AS en FROM es JOIN en ON en.i = es.i % en.n""")
def s2(spark, sf):
    folder = scratch(spark, "parallel")
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    en, es = (positions(d.filter(F.col("lang") == x), ["doc_id"], out="i").select("i", F.col("text").alias(x)) for x in ("en", "es"))
    n = d.agg(F.count_if(F.col("lang") == "en")).scalar()
    both = es.withColumn("i", F.col("i") % n).join(en, "i")
    both.select(F.struct("en", "es").alias("translation")).write.parquet(f"{folder}/pairs")
    return files.read_parallel(spark, f"{folder}/pairs")


@query("s3_read_run_table", f"WITH {RUNS} SELECT run, idx, response_length FROM runs")
def s3(spark, sf):
    folder = scratch(spark, "runs")
    files.write_run_table(runs(spark, sf).select("run", "idx", "response_length"), f"{folder}/runs")
    return files.read_run_table(spark, f"{folder}/runs").select("run", "idx", "response_length")


@query("s3_read_run_arrays", f"""WITH {RUNS} SELECT run, idx, query, generation, round(holistic_reward, 6) AS holistic_reward, round(readability, 6) AS readability,
  grammar_errors, response_length FROM runs""")
def s3c(spark, sf):
    folder = scratch(spark, "arrays")
    files.write_runs(runs(spark, sf).select("run", "idx", "query", "generation", "holistic_reward", "readability", "grammar_errors", "response_length"), folder)
    out = files.read_runs(spark, folder)
    return out.select("run", "idx", "query", "generation", r6("holistic_reward").alias("holistic_reward"), r6("readability").alias("readability"), "grammar_errors", "response_length")


RUN_METRICS = ["holistic_reward", "readability", "error_rate", "grammar_errors", "response_length"]


@query("s3_read_run_lines", f"WITH {RUNS} SELECT run, idx, query, generation, {', '.join(f'round({m}, 6) AS {m}' if m in RUN_METRICS[:3] else m for m in RUN_METRICS)} FROM runs")
def s3b(spark, sf):
    folder = scratch(spark, "lines")
    files.write_run_lines(runs(spark, sf).select("run", "idx", "query", "generation", *RUN_METRICS), f"{folder}/runs")
    types = ", ".join(f"{m} {'bigint' if m in ('grammar_errors', 'response_length') else 'double'}" for m in RUN_METRICS)
    out = files.read_run_lines(spark, f"{folder}/runs", f"query string, generation string, {types}")
    return out.withColumns({m: r6(m) for m in RUN_METRICS[:3]})


def written_requests(spark, sf):
    folder = scratch(spark, "requests")
    made = reqops.judge_requests(judged_pairs(spark, sf), F.lit(textops.DEFAULT_JUDGE_TEMPLATE), "judge")
    made.select(F.col("request").alias("value")).write.text(f"{folder}/requests")
    return folder


JUDGE_FILLED = f"replace(replace(replace({sq(JUDGE_USER)}, '{{instruction}}', query), '{{output_1}}', ga), '{{output_2}}', gb)"


@query("s4_read_requests", f"""WITH {JUDGED} SELECT run_a, run_b, idx::VARCHAR AS id, 'judge' AS model, false AS has_metadata,
  {JUDGE_FILLED} AS user_text, {sq(JUDGE_SYSTEM)} AS system_text FROM jpairs WHERE ga <> gb""")
def s4(spark, sf):
    r = files.read_requests(spark, f"{written_requests(spark, sf)}/requests")
    get = F.get_json_object
    return r.select(
        get("metadata", "$.name_a").alias("run_a"), get("metadata", "$.name_b").alias("run_b"), get("metadata", "$.id").alias("id"),
        get("request", "$.model").alias("model"), get("request", "$.metadata").isNotNull().alias("has_metadata"),
        get("request", "$.messages[1].content").alias("user_text"), get("request", "$.messages[0].content").alias("system_text"),
    )


@query("s5_s6_results_round_trip", f"""WITH {JUDGED} SELECT run_a, run_b, idx, idx % 13 = 0 AS failed, CASE WHEN idx % 13 = 0 THEN NULL
  WHEN length(ga) % 3 = 0 THEN 1 WHEN length(ga) % 3 = 1 THEN 0 END::BIGINT AS verdict FROM jpairs WHERE ga <> gb""")
def s5(spark, sf):
    folder = scratch(spark, "results")
    p = judged_pairs(spark, sf).filter("generation_a <> generation_b")
    n = F.length("generation_a") % 3
    said = F.when(n == 0, "Output (a)").when(n == 1, "output (B)").otherwise("neither")
    tool = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(F.struct(said.alias("arguments")).alias("function"))).alias("tool_calls")).alias("message"))).alias("choices")))
    plain = F.to_json(F.struct(F.array(F.struct(F.struct(said.alias("content")).alias("message"))).alias("choices")))
    response = F.when(F.col("idx") % 13 == 0, F.lit('["error", "error"]')).when(F.col("idx") % 2 == 0, tool).otherwise(plain)
    meta = F.to_json(F.struct(F.col("run_a").alias("name_a"), F.col("run_b").alias("name_b"), F.col("idx").alias("id")))
    files.write_results(p.select(F.lit('{"model": "judge"}').alias("request"), response.alias("response"), meta.alias("metadata")), f"{folder}/out")
    return files.read_results(spark, f"{folder}/out").select("run_a", "run_b", "idx", "failed", big("verdict").alias("verdict"))


@query("s7_write_tree", f"""{BASE}, signs AS (SELECT run_a, run_b, metric, sign(ha - hb) AS o,
  CASE WHEN metric IN ('error_rate', 'grammar_errors') THEN -1 ELSE 1 END * sign(va - vb) AS m FROM pairs),
  inc AS (SELECT run_a, run_b, metric, CASE WHEN count(*) FILTER (o <> 0) > 0 THEN 100.0::DOUBLE * count(*) FILTER (o * m < 0) / count(*) FILTER (o <> 0)
  ELSE 0.0::DOUBLE END AS i FROM signs GROUP BY ALL)
  SELECT run_a AS run, run_b AS cell, metric, round(win_rate, 6) AS value, round(i, 6) AS inconsistent FROM rates JOIN inc USING (run_a, run_b, metric)
  UNION ALL SELECT run_a, 'Avg.', metric, round(avg(win_rate), 6), NULL FROM rates GROUP BY run_a, metric
  UNION ALL SELECT run, metric || '-Mean', NULL, round(avg(v), 6), NULL FROM long_runs GROUP BY run, metric
  UNION ALL SELECT DISTINCT run, run, '*', NULL::DOUBLE, NULL::DOUBLE FROM runs""")
def s7(spark, sf):
    """Every cell of the tree, read back from the file."""
    folder = scratch(spark, "tree")
    r = keep(runs(spark, sf), "runs")
    rates = cmp.win_rate(cmp.win_counts(r, METRICS)).join(cmp.inconsistency(r, METRICS), ["run_a", "run_b", "metric"])
    files.write_tree(cmp.metric_summary(r, METRICS), rates, f"{folder}/tree")
    v = F.parse_json("value")
    lines = spark.read.text(f"{folder}/tree").select(
        F.variant_get(v, "$.run", "string").alias("run"), F.explode(F.variant_get(v, "$.results", "map<string,variant>")).alias("cell", "c")
    )
    inner = F.coalesce(F.try_variant_get("c", "$", "map<string,variant>"), F.create_map(F.lit(""), F.col("c")))
    cells = lines.select("run", "cell", F.explode(inner).alias("metric", "m"))
    number = lambda path: F.try_variant_get("m", path, "double")
    mark = F.when(number("$").isNull() & (F.col("metric") == ""), F.try_variant_get("m", "$", "string"))
    return cells.select(
        "run", "cell", F.coalesce(mark, F.nullif(F.col("metric"), F.lit(""))).alias("metric"),
        r6(F.coalesce(number("$"), number("$.win_rate"))).alias("value"), r6(number("$.holistic_reward_inconsistent")).alias("inconsistent"),
    )


@query("s8_write_generations", f"WITH {RUNS} SELECT run, query, response_length FROM runs QUALIFY row_number() OVER (PARTITION BY query ORDER BY doc_id) = 1")
def s8(spark, sf):
    folder = scratch(spark, "generations")
    files.write_generations(runs(spark, sf).select("doc_id", "run", "query", "response_length"), f"{folder}/out", "doc_id")
    return spark.read.schema("run string, query string, response_length bigint").json(f"{folder}/out")


@query("s9_write_once", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def s9(spark, sf):
    path = f"{scratch(spark, 'once')}/counts"
    counts = lambda: load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    files.write_once(spark, path, counts)
    return files.write_once(spark, path, counts, use_cache=True)


@query("st1_stream_requests", f"""WITH {JUDGED}, filled AS (SELECT idx, run_a, {sql_count(text.TOKEN, sq(JUDGE_SYSTEM))} + {sql_count(text.TOKEN, JUDGE_FILLED)} AS n FROM jpairs WHERE ga <> gb)
  SELECT idx::VARCHAR AS id, run_a, (2 * n + 37)::BIGINT AS tokens FROM filled""")
def st1(spark, sf):
    folder = written_requests(spark, sf)
    streams.run_available(streams.requests(spark, f"{folder}/requests", 1), f"{folder}/out", f"{folder}/ckpt")
    out = spark.read.parquet(f"{folder}/out")
    return out.select(F.get_json_object("metadata", "$.id").alias("id"), F.get_json_object("metadata", "$.name_a").alias("run_a"), big("tokens").alias("tokens"))


# a given table of failures: an attempt at a document fails by the hash of both
FAILS = "CAST('0x' || substr(md5(doc_id || ':' || attempt), 1, 2) AS INTEGER) < 144"


@query("st1_retry_until_done", f"""WITH a AS (SELECT doc_id, n_chars, unnest(range(0, 5)) AS attempt FROM documents), b AS (SELECT *, {FAILS} AS fails FROM a),
  c AS (SELECT doc_id, n_chars, min(attempt) FILTER (NOT fails) AS won FROM b GROUP BY ALL)
  SELECT doc_id AS task_id, CASE WHEN won IS NULL THEN 'failed' ELSE 'succeeded' END AS status, coalesce(won + 1, 5)::BIGINT AS attempts,
  coalesce(won, 5)::BIGINT AS errors, n_chars::BIGINT AS chars, 0::BIGINT AS pending FROM c""")
def st1b(spark, sf):
    folder = scratch(spark, "retry")
    tasks = documents(spark, sf).select(F.col("doc_id").alias("task_id"), F.to_json(F.struct(F.col("n_chars").alias("prompt_chars"))).alias("request"))
    streams.enqueue(tasks, folder)

    def send(df):
        fails = F.conv(F.substring(F.md5(F.concat_ws(":", "task_id", "attempt").cast("binary")), 1, 2), 16, 10).cast("int") < 144
        return df.withColumn("ok", ~fails).withColumn("error", F.when(fails, "timeout"))

    streams.work_off(spark, folder, send)
    tried = spark.read.parquet(f"{folder}/attempts")
    each = tried.groupBy("task_id").agg(F.max("ok").alias("won"), F.count(F.lit(1)).alias("attempts"), F.count("error").alias("errors"), F.first("request").alias("request"))
    open_ = each.agg(F.count_if(~F.col("won") & (F.col("attempts") < 5))).scalar()
    chars = F.get_json_object("request", "$.prompt_chars").cast("bigint")
    return each.select("task_id", F.when(F.col("won"), "succeeded").otherwise("failed").alias("status"), "attempts", "errors", chars.alias("chars"), open_.alias("pending"))


LOG_SLICES = 6
#: rows that a file of a slice has at least, so that none is empty
FILE_ROWS = 100


def streamed_log(spark, sf, marker=True):
    """The attempt log written as slices in the order of time, one to a micro-batch, and the folder to work in. The log is cut by time once; each slice
    then reads its own part of it and is written as equally many files by as many tasks. A last file holds a marker row
    without a task, three hours after all others, which moves the watermark beyond them."""
    folder = scratch(spark, "log")
    log = attempt_log(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    log = keep(log.repartitionByRange("ts").sortWithinPartitions("ts"), "cut")
    span = log.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    step = (span["b"] - span["a"]) / LOG_SLICES
    inside = [(F.col("ts") >= F.lit(span["a"] + k * step)) & ((F.col("ts") < F.lit(span["a"] + (k + 1) * step)) | F.lit(k == LOG_SLICES - 1)) for k in range(LOG_SLICES)]
    rows = log.agg(*[F.count_if(i).alias(f"n{k}") for k, i in enumerate(inside)]).first()
    files_each = max(1, min(spark.sparkContext.defaultParallelism, min(rows) // FILE_ROWS))
    for i in inside:
        log.filter(i).repartition(files_each).write.mode("append").parquet(f"{folder}/log")
    if marker:
        end = log.limit(0).unionByName(
            log.agg((F.max("ts") + F.expr("INTERVAL 3 HOURS")).alias("ts")), allowMissingColumns=True
        )
        end.coalesce(1).write.mode("append").parquet(f"{folder}/log")
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files_each).parquet(f"{folder}/log"), folder


@query("st2_stream_usage", f"""WITH {LOG} SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, sum(tokens)::BIGINT AS tokens
  FROM log GROUP BY date_trunc('minute', ts)""")
def st2(spark, sf):
    log, folder = streamed_log(spark, sf)
    streams.run_available(streams.usage(log), f"{folder}/out", f"{folder}/ckpt")
    return spark.read.parquet(f"{folder}/out").withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm"))


@query("st3_stream_cooldowns", f"WITH {LOG}, {COOL.format(gap='15 SECONDS')}")
def st3(spark, sf):
    log, folder = streamed_log(spark, sf)
    streams.run_available(streams.cooldowns(log, shards=4), f"{folder}/out", f"{folder}/ckpt")
    out = reqops.merge_spans(spark.read.parquet(f"{folder}/out").drop("shard"))
    return out.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n_errors")


@query("st4_stream_task_status", f"WITH {LOG}, {STATUS} SELECT * FROM status WHERE status <> 'pending'")
def st4(spark, sf):
    log, folder = streamed_log(spark, sf)
    streams.run_available(streams.task_status(log), f"{folder}/out", f"{folder}/ckpt")
    return spark.read.parquet(f"{folder}/out").select("task_id", "status", F.array_join("errors", ",").alias("errors"))


@query("st5_stream_status_counts", f"""WITH {LOG}, {STATUS} SELECT count(*) AS started, count(*) FILTER (status = 'pending') AS in_progress,
  count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  (SELECT count(*) FILTER (error LIKE 'Rate limit%') FROM log) AS rate_limit_errors,
  (SELECT count(*) FILTER (NOT ok AND api AND error NOT LIKE 'Rate limit%') FROM log) AS api_errors,
  (SELECT count(*) FILTER (NOT ok AND NOT api) FROM log) AS other_errors FROM status""")
def st5(spark, sf):
    log, folder = streamed_log(spark, sf, marker=False)
    streams.run_available(streams.error_counts(log), f"{folder}/errors", f"{folder}/ckpt1", "update")
    streams.run_available(streams.task_changes(log), f"{folder}/tasks", f"{folder}/ckpt2", save=lambda df, k: streams.add_up(df, k, f"{folder}/tasks"))
    tasks = streams.task_counters(spark, f"{folder}/tasks")
    errors = streams.latest(spark, f"{folder}/errors", []).select(F.struct("*")).scalar()
    return tasks.withColumn("_e", errors).select(*tasks.columns, "_e.*")


@query("st6_stream_eval_means", "SELECT event_type AS run, count(*) AS n, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def st6(spark, sf):
    folder = scratch(spark, "eval")
    load(spark, sf, "events").select(F.col("event_type").alias("run"), "value").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("run string, value double").parquet(f"{folder}/in")
    streams.run_available(streams.eval_means(stream, ["value"]), f"{folder}/out", f"{folder}/ckpt", "update")
    return streams.latest(spark, f"{folder}/out", ["run"]).withColumn("value", r6("value"))


def length_scorer():
    return lambda texts: [len(t) / 100 for t in texts]


@query("u1_score", "SELECT doc_id, round(length(text) / 100.0::DOUBLE, 6) AS score FROM documents")
def u1(spark, sf):
    out = models.score(documents(spark, sf).select("doc_id", "text"), "text", length_scorer)
    return out.select("doc_id", r6("score").alias("score"))


def as_dialogue(b: pd.DataFrame) -> list[str]:
    return ("Asked: " + b["query"] + "\nSaid: " + b["response"]).tolist()


@query("u2_format_examples", f"WITH {TURNS} SELECT conv_id * 100 + turn AS id, 'Asked: ' || query || chr(10) || 'Said: ' || response AS text FROM turns")
def u2(spark, sf):
    t = turns(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "query", "response")
    return models.format_examples(t, as_dialogue, "id")


@query("u3_metric_agg", "SELECT event_type, round(avg(((value > 30)::INT = user_id % 2)::INT), 6) AS metric FROM events GROUP BY event_type")
def u3(spark, sf):
    ev = load(spark, sf, "events").select("event_type", (F.col("value") > 30).cast("int").alias("p"), (F.col("user_id") % 2).cast("int").alias("l"))
    out = models.metric_agg(ev, lambda p, y: (float((p == y).sum()), float(len(p))), "p", "l", ["event_type"])
    return out.select("event_type", r6("metric").alias("metric"))


# three classes of documents: junk, good, toxic
CLASSED = """classed AS (SELECT doc_id, text, CASE WHEN toxic = 1 THEN 2 ELSE quality END AS label FROM documents JOIN labels USING (doc_id))"""


def classed(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", "text").join(load(spark, sf, "labels"), "doc_id")
    return rows.select("doc_id", "text", F.when(F.col("toxic") == 1, 2).otherwise(F.col("quality")).alias("label"))


def shares_sql(rows, features):
    """Token shares: ``doc_id, k, v`` of the (doc_id, text) rows."""
    return f"""SELECT doc_id, id % {features} AS k, count(*)::DOUBLE / any_value(n) AS v
    FROM (SELECT doc_id, len(ids) AS n, unnest(ids) AS id FROM (SELECT doc_id, {sql_ids('text')} AS ids FROM {rows})) GROUP BY ALL"""


def descent_sql(steps, rate, reg, classes, features):
    """Full gradient steps over ``x`` (doc_id, k, v) and ``y`` (doc_id, label) as common table expressions ``w0`` .. ``w<steps>`` (c, k, w)."""
    out = [f"w0 AS (SELECT c, k, 0.0::DOUBLE AS w FROM range({classes}) a(c), range({features}) b(k))", "total AS (SELECT count(*) AS n FROM y)"]
    for i in range(1, steps + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT doc_id, c, sum(v * w) AS m FROM x JOIN w{i - 1} USING (k) GROUP BY doc_id, c)")
        if classes == 1:
            out.append(f"p{i} AS MATERIALIZED (SELECT doc_id, c, 1 / (1 + exp(m)) AS pull FROM m{i})")
        else:
            out.append(f"p{i} AS MATERIALIZED (SELECT doc_id, c, (label = c)::INT - exp(m) / sum(exp(m)) OVER (PARTITION BY doc_id) AS pull FROM m{i} JOIN y USING (doc_id))")
        out.append(f"g{i} AS MATERIALIZED (SELECT c, k, sum(v * pull) AS g FROM x JOIN p{i} USING (doc_id) GROUP BY c, k)")
        out.append(f"w{i} AS MATERIALIZED (SELECT c, k, w + {rate} * (coalesce(g, 0) / n - {reg} * w) AS w FROM w{i - 1} LEFT JOIN g{i} USING (c, k), total)")
    return ", ".join(out)


U4_SQL = f"""WITH {CLASSED}, x AS MATERIALIZED ({shares_sql("(SELECT * FROM classed WHERE doc_id % 3 <> 0)", 1024)}), y AS (SELECT doc_id, label FROM classed WHERE doc_id % 3 <> 0),
  {descent_sql(8, 200.0, 0.0001, 3, 1024)}, z AS ({shares_sql("(SELECT * FROM classed WHERE doc_id % 3 = 0)", 1024)}),
  s AS (SELECT doc_id, c, sum(v * w) AS s FROM z JOIN w8 USING (k) GROUP BY doc_id, c)
  SELECT doc_id, {', '.join(f"round(coalesce(sum(s) FILTER (c = {c}), 0), 6) + 0.0 AS logit{c}" for c in range(3))} FROM classed LEFT JOIN s USING (doc_id) WHERE doc_id % 3 = 0 GROUP BY doc_id"""


@query("u4_segment_classifier", U4_SQL)
def u4(spark, sf):
    """Learned from two thirds of the labelled documents; logits of the other third."""
    rows = keep(classed(spark, sf), "classed")
    model = models.fit_segments(rows.filter("doc_id % 3 <> 0"), "text", "label")
    out = models.segment_logits(rows.filter("doc_id % 3 = 0").select("doc_id", "text"), model, "text")
    return out.select("doc_id", *[r6(F.col("logits")[c]).alias(f"logit{c}") for c in range(3)])


D12_SQL = f"""WITH {CLASSED}, good AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM classed WHERE label = 1),
  bad AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM classed WHERE label = 0),
  y AS (SELECT good.doc_id, bad.doc_id AS rejected_id, 0 AS label FROM good JOIN bad ON bad.i = good.i % bad.n),
  shares AS MATERIALIZED ({shares_sql("classed", 4096)}),
  x AS MATERIALIZED (SELECT doc_id, k, sum(v) AS v FROM (SELECT y.doc_id, k, v FROM y JOIN shares USING (doc_id)
    UNION ALL SELECT y.doc_id, k, -v FROM y JOIN shares ON shares.doc_id = y.rejected_id) GROUP BY ALL),
  {descent_sql(8, 400.0, 0.0001, 1, 4096)}, s AS (SELECT doc_id, sum(v * w) AS s FROM shares JOIN w8 USING (k) GROUP BY doc_id)
  SELECT y.doc_id, rejected_id, round(coalesce(a.s, 0), 6) + 0.0 AS chosen_score, round(coalesce(b.s, 0), 6) + 0.0 AS rejected_score
  FROM y LEFT JOIN s a ON a.doc_id = y.doc_id LEFT JOIN s b ON b.doc_id = y.rejected_id"""


@query("d12_fit_reward", D12_SQL)
def d12(spark, sf):
    """Good documents against junk: the scores of both sides of each pair."""
    rows = keep(classed(spark, sf), "classed")
    good, bad = (positions(rows.filter(F.col("label") == k), ["doc_id"], out="i") for k in (1, 0))
    n = rows.agg(F.count_if(F.col("label") == 0)).scalar()
    bad = bad.select("i", F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    p = keep(good.select((F.col("i") % n).alias("i"), "doc_id", F.col("text").alias("chosen")).join(bad, "i").drop("i"), "pairs")
    model = models.fit_reward(p, "chosen", "rejected")
    scores = models.reward_score(models.reward_score(p, model, "chosen", "c"), model, "rejected", "r")
    return scores.select("doc_id", "rejected_id", r6("c").alias("chosen_score"), r6("r").alias("rejected_score"))
