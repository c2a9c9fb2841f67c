"""Registered text measure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.functions import automaton, grammar, text
from prefloom.functions.common import big, r6, ratio
from prefloom.operators import textops
from prefloom.plans.prep import joined
from prefloom.session import keep
from prefloom.plans.registry import load, query
from prefloom.plans.tables import (
    SQL_FK, SQL_FRE, SQL_GRAMMAR, SQL_SENTENCES, SQL_SYLLABLES, SQL_WORDS, TURNS, documents, sq, sql_count, turns,
)

COUNTED = f"counted AS (SELECT doc_id, text, {SQL_WORDS} AS w, {SQL_SENTENCES} AS s, {SQL_SYLLABLES} AS y FROM documents)"
SENT_LIST = f"regexp_extract_all({{c}}, {sq(text.SENTENCE)})"
BLANK = "regexp_replace(p, '\\s+', '', 'g') = ''"
# sentences with running character offsets: id columns, seg, start, end, sent
def sentence_rows(src: str, ids: str, c: str) -> str:
    return f"""sent0 AS (SELECT {ids}, unnest({SENT_LIST.format(c=c)}) AS p, generate_subscripts({SENT_LIST.format(c=c)}, 1) AS k
  FROM {src}), sent AS (SELECT {ids}, p, k, (sum(length(p)) OVER (PARTITION BY {ids} ORDER BY k))::BIGINT AS e FROM sent0),
  sents AS (SELECT {ids}, p AS sent, e - length(p) AS b, e, row_number() OVER (PARTITION BY {ids} ORDER BY k) - 1 AS seg
  FROM sent WHERE NOT ({BLANK}))"""


@query("x1_sentences", f"""WITH {sentence_rows('documents', 'doc_id', 'text')} SELECT d.doc_id,
  coalesce('0,' || string_agg(e, ',' ORDER BY seg), '0') AS ends FROM documents d LEFT JOIN sents USING (doc_id) GROUP BY d.doc_id""")
def x1(spark, sf):
    return documents(spark, sf).select("doc_id", joined(text.sentence_ends("text")).alias("ends"))


GAPS = "string_split_regex(sent, '\\S+')"
WORDS_OF = "regexp_extract_all(sent, '\\S+')"
WORD_START = "(list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(toks[1:i], lambda g: length(g))), 0))::BIGINT"
WORD_ROWS = f"""split AS (SELECT *, {GAPS} AS gaps, {WORDS_OF} AS toks FROM sents)"""


@query("x2_tokens_with_offsets", f"""WITH {TURNS}, {sentence_rows('turns', 'conv_id, turn', 'response')}, {WORD_ROWS},
  w AS (SELECT *, unnest(range(0, len(toks))) AS i FROM split)
  SELECT conv_id, turn, seg::BIGINT AS seg, i::BIGINT AS pos, toks[i + 1] AS token, {WORD_START} AS start FROM w""")
def x2(spark, sf):
    t = turns(spark, sf).select("conv_id", "turn", F.posexplode(text.sentence_spans("response")).alias("seg", "s"))
    t = t.select("conv_id", "turn", "seg", F.posexplode(text.tokens_with_offsets("s.text")).alias("pos", "t"))
    return t.select("conv_id", "turn", big("seg").alias("seg"), big("pos").alias("pos"), "t.token", big("t.start").alias("start"))


PIECES = """list_reduce(list_filter(range(1, len(toks)), lambda i: regexp_matches(toks[i], '[,;!?]$') AND i + 5 < len(toks)),
  lambda st, i: CASE WHEN i - st[-1] >= 5 THEN list_append(st, i) WHEN st[-1] > 0 THEN list_append(st[1:len(st) - 1], i) ELSE st END,
  [0::BIGINT])"""
SUBCUTS = f"""{WORD_ROWS}, starts AS (SELECT *, unnest({PIECES}) AS i FROM split)"""


@query("x3_subsentences", f"""WITH {sentence_rows('documents', 'doc_id', 'text')}, {SUBCUTS},
  cuts AS (SELECT doc_id, b + {WORD_START} AS c FROM starts UNION ALL SELECT doc_id, length(text) FROM documents)
  SELECT doc_id, string_agg(c, ',' ORDER BY c) AS cuts FROM cuts GROUP BY doc_id""")
def x3(spark, sf):
    return documents(spark, sf).select("doc_id", joined(text.subsentence_cuts("text")).alias("cuts"))


@query("x4_segments", f"""WITH {TURNS}, {sentence_rows('turns', 'conv_id, turn', 'response')}
  SELECT conv_id, turn, seg::BIGINT AS seg, b::BIGINT AS start, e::BIGINT AS "end", sent AS segment,
  (least({sql_count(text.TOKEN, 'response[:e]')} - 1, {sql_count(text.TOKEN, 'response')} - 1))::BIGINT AS end_pos
  FROM sents JOIN turns USING (conv_id, turn)""")
def x4(spark, sf):
    out = textops.segments(turns(spark, sf), "response", text.sentence_ends("response"), text.token_count("response"))
    return out.select("conv_id", "turn", "seg", big("start").alias("start"), big("end").alias("end"), "segment", big("end_pos").alias("end_pos"))


@query("x5_fk_grade", f"WITH {COUNTED} SELECT doc_id, round({SQL_FK}, 6) AS fk_grade FROM counted")
def x5(spark, sf):
    return documents(spark, sf).select("doc_id", r6(text.fk_grade(text.text_counts("text"))).alias("fk_grade"))


@query("x6_reading_ease", f"WITH {COUNTED} SELECT doc_id, round({SQL_FRE}, 6) AS reading_ease FROM counted")
def x6(spark, sf):
    return documents(spark, sf).select("doc_id", r6(text.reading_ease(text.text_counts("text"))).alias("reading_ease"))


FAMILIAR = f"familiar AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), {sq(text.WORD)})) AS word FROM benchmark)"
DC = f"""{COUNTED}, {FAMILIAR}, words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), {sq(text.WORD)})) AS word FROM documents),
  unf AS (SELECT doc_id, count(*) AS u FROM words WHERE word NOT IN (SELECT word FROM familiar) GROUP BY doc_id),
  dc AS (SELECT doc_id, {SQL_FK} AS fk, {SQL_FRE} AS fre, coalesce(CASE WHEN coalesce(u, 0) * 100 / nullif(w, 0) > 5
  THEN 0.1579 * (coalesce(u, 0) * 100 / nullif(w, 0)) + 0.0496 * (w / s) + 3.6365
  ELSE 0.1579 * (coalesce(u, 0) * 100 / nullif(w, 0)) + 0.0496 * (w / s) END, 0.0) AS dc FROM counted LEFT JOIN unf USING (doc_id))"""


def familiar(spark, sf):
    words = F.explode(text.find_all(F.lower(F.col("text")), text.WORD)).alias("word")
    return load(spark, sf, "benchmark").select(words).distinct()


@query("x7_dale_chall", f"WITH {DC} SELECT doc_id, round(dc, 6) AS dale_chall FROM dc")
def x7(spark, sf):
    out = textops.readability(documents(spark, sf), "doc_id", "text", familiar(spark, sf))
    return out.select("doc_id", r6("dale_chall").alias("dale_chall"))


@query("x8_readability_report", f"""WITH {DC} SELECT round(avg(dc), 6) AS dale_chall, round(avg(fk), 6) AS fk_grade,
  round(avg(fre), 6) AS reading_ease FROM dc""")
def x8(spark, sf):
    out = textops.readability_report(documents(spark, sf), "doc_id", "text", familiar(spark, sf))
    return out.select(*[r6(c).alias(c) for c in out.columns])


LANGS = ["en", "es", "fr", "de"]
GRAMS = "list_transform(range(1, length(text) - 1), lambda i: substr(lower(text), i, 3))"


@query("x9_fit_lang", f"""WITH g AS (SELECT lang, unnest({GRAMS}) AS gram FROM documents) SELECT gram,
  {', '.join(f"count(*) FILTER (lang = '{n}') AS {n}" for n in LANGS)} FROM g GROUP BY gram""")
def x9a(spark, sf):
    model = textops.fit_lang(documents(spark, sf), "text", "lang", LANGS)
    return model.select("gram", *[F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(LANGS)])


@query("x9_lang_conf", f"""WITH g AS (SELECT doc_id, lang, unnest({GRAMS}) AS gram FROM documents),
  m AS (SELECT gram, {', '.join(f"count(*) FILTER (lang = '{n}') AS {n}" for n in LANGS)} FROM g GROUP BY gram),
  z AS (SELECT count(*) AS v, {', '.join(f"sum({n}) AS n_{n}" for n in LANGS)} FROM m),
  s AS (SELECT doc_id, {', '.join(f"sum(ln(({n} + 1)::DOUBLE / (n_{n} + v)::DOUBLE)) AS s_{n}" for n in LANGS)}
  FROM g JOIN m USING (gram), z GROUP BY doc_id)
  SELECT doc_id, round(coalesce(1.0 / ({' + '.join(f"exp(s_{n} - s_en)" for n in LANGS)}), 1.0 / 4), 6) AS confidence
  FROM documents LEFT JOIN s USING (doc_id)""")
def x9b(spark, sf):
    docs = documents(spark, sf)
    model = keep(textops.fit_lang(docs, "text", "lang", LANGS), "lang")
    out = textops.lang_conf(docs, "doc_id", "text", model, LANGS, "en")
    return out.select("doc_id", r6("confidence").alias("confidence"))


def rule_sql(name: str, pattern: str) -> str:
    return f"""SELECT doc_id, '{name}' AS rule_id, unnest(regexp_extract_all(text, {sq(pattern)})) AS hit,
  generate_subscripts(regexp_extract_all(text, {sq(pattern)}), 1) AS k, string_split_regex(text, {sq(pattern)}) AS gaps,
  regexp_extract_all(text, {sq(pattern)}) AS hits FROM documents"""


MATCHES = "found AS (" + " UNION ALL ".join(rule_sql(*r) for r in grammar.RULES) + """), matches AS (SELECT doc_id, rule_id,
  (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda g: length(g))), 0))::BIGINT
  AS "offset", length(hit) AS error_length FROM found)"""


@query("x10_grammar_matches", f"WITH {MATCHES} SELECT * FROM matches")
def x10(spark, sf):
    out = textops.grammar_matches(documents(spark, sf), "doc_id", "text")
    return out.select("doc_id", "rule_id", big("offset").alias("offset"), big("error_length").alias("error_length"))


# rules from a table: each longer word of the benchmark twice in a row, and an "a" before each that begins with a vowel
TABLE_WORDS = "SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]{4,9}$')"


@query("x10_rule_table", f"""WITH words AS ({TABLE_WORDS}), rules AS (SELECT 'twice:' || w AS rule_id, '\\b' || w || ' +' || w || '\\b' AS pattern, w FROM words
  UNION ALL SELECT 'article:' || w, '\\ba ' || w || '\\b', w FROM words WHERE regexp_matches(w, '^[aeiou]'))
  SELECT doc_id, rule_id, len(regexp_extract_all(text, pattern))::BIGINT AS n FROM documents JOIN rules ON contains(text, w)
  WHERE regexp_matches(text, pattern)""")
def x10b(spark, sf):
    docs = documents(spark, sf)
    words = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w")).filter("w rlike '^[a-z]{4,9}$'").distinct()
    twice = words.select(F.concat(F.lit("twice:"), "w").alias("rule_id"), F.concat(F.lit(r"\b"), "w", F.lit(" +"), "w", F.lit(r"\b")).alias("pattern"))
    article = words.filter("w rlike '^[aeiou]'").select(F.concat(F.lit("article:"), "w").alias("rule_id"), F.concat(F.lit(r"\ba "), "w", F.lit(r"\b")).alias("pattern"))
    rules = automaton.rules_of(twice.union(article))
    found = textops.grammar_matches(docs, "doc_id", "text", rules)
    return found.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query("x11_error_rate", f"""SELECT doc_id, {SQL_GRAMMAR}::BIGINT AS grammar_errors,
  round({SQL_GRAMMAR} / nullif({sql_count(text.TOKEN)}, 0)::DOUBLE, 6) AS error_rate FROM documents""")
def x11(spark, sf):
    n = F.size(automaton.rule_spans("text", grammar.RULES))
    return documents(spark, sf).select(
        "doc_id", big(n).alias("grammar_errors"), r6(ratio(n, text.token_count("text"))).alias("error_rate")
    )


@query("x12_mark_spans", f"""WITH {MATCHES}, words AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS w,
  unnest(string_split_regex(text, '\\S+')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '\\S+'), 1) - 1 AS pos FROM documents),
  t AS (SELECT doc_id, pos, length(w) AS n, (sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS e FROM words),
  f AS (SELECT m.doc_id, m.rule_id, m."offset", m.error_length, min(pos) AS first FROM matches m JOIN t ON t.doc_id = m.doc_id
  AND (t.e >= m."offset") GROUP BY ALL),
  marked AS (SELECT DISTINCT f.doc_id, t.pos FROM f JOIN t a ON a.doc_id = f.doc_id AND a.pos = f.first
  JOIN t ON t.doc_id = f.doc_id AND t.pos >= f.first AND t.e - (a.e - a.n) <= f.error_length)
  SELECT d.doc_id, {sql_count(r'\S+')}::BIGINT AS n_tokens, coalesce(x.marked, '') AS marked FROM documents d
  LEFT JOIN (SELECT doc_id, string_agg(pos, ',' ORDER BY pos) AS marked FROM marked GROUP BY doc_id) x USING (doc_id)""")
def x12(spark, sf):
    out = textops.mark_spans(documents(spark, sf), "text")
    at = F.transform("grammar_rewards", lambda r, i: F.when(r < 0, i))
    return out.select(
        "doc_id", big(F.size("grammar_rewards")).alias("n_tokens"), joined(F.filter(at, lambda i: i.isNotNull())).alias("marked")
    )


def bleu_sql(c: str) -> str:
    c = f"' ' || {c} || ' '"
    for pattern, new in textops.BLEU_13A:
        c = f"regexp_replace({c}, {sq(pattern)}, {sq(new.replace('$', chr(92)))}, 'g')"
    return f"regexp_extract_all({c}, '\\S+')"


DROP7 = "array_to_string(list_filter(regexp_extract_all(text, '\\S+'), lambda w, i: i % 7 <> 0), ' ')"


@query("x13_corpus_bleu", f"""WITH t AS (SELECT doc_id, {bleu_sql(DROP7)} AS h, {bleu_sql('text')} AS r FROM documents),
  g AS ({' UNION ALL '.join(f"SELECT doc_id, {n} AS n, '{s}' AS side, unnest(list_transform(range(1, len({s}) - {n} + 2), lambda i: array_to_string({s}[i:i + {n} - 1], ' '))) AS gram FROM t" for n in range(1, 5) for s in 'hr')}),
  c AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
  k AS (SELECT {', '.join(f"sum(least(h, r)) FILTER (n = {n}) AS m{n}, sum(h) FILTER (n = {n}) AS t{n}" for n in range(1, 5))},
  sum(r) FILTER (n = 1) AS rl FROM c)
  SELECT {', '.join(f"m{n}::BIGINT AS match{n}, t{n}::BIGINT AS total{n}" for n in range(1, 5))}, rl::BIGINT AS ref_len,
  round(100 * exp(({' + '.join(f"ln(m{n}::DOUBLE / t{n}::DOUBLE)" for n in range(1, 5))}) / 4)
  * CASE WHEN t1 >= rl THEN 1.0 ELSE exp(1.0 - rl::DOUBLE / t1::DOUBLE) END, 6) AS bleu FROM k""")
def x13(spark, sf):
    kept = F.filter(text.find_all(F.col("text"), text.NON_SPACE), lambda w, i: (i + 1) % 7 != 0)
    pairs = documents(spark, sf).select("doc_id", "text", F.array_join(kept, " ").alias("hyp"))
    out = textops.corpus_bleu(pairs, "hyp", "text")
    return out.select(*[c for c in out.columns if c.startswith(("match", "total", "ref"))], r6("bleu").alias("bleu"))


@query("x14_between_tags", """SELECT page_id, len(regexp_extract_all(html, '(?s)\\Q<p>\\E(.*?)\\Q</p>\\E', 1))::BIGINT AS n,
  array_to_string(regexp_extract_all(html, '(?s)\\Q<p>\\E(.*?)\\Q</p>\\E', 1), '|') AS found FROM pages""")
def x14(spark, sf):
    found = text.between_tags("html", "<p>", "</p>")
    return load(spark, sf, "pages").select("page_id", big(F.size(found)).alias("n"), F.array_join(found, "|").alias("found"))


JUDGE_SYSTEM, JUDGE_USER = [
    p.split("\n", 1)[1].split(textops.END_TAG)[0] for p in textops.DEFAULT_JUDGE_TEMPLATE.split("<|im_start|>")[1:]
]


@query("x15_judge_conversation", f"""WITH {TURNS} SELECT conv_id, turn, {sq(JUDGE_SYSTEM)} AS system_text,
  replace(replace(replace({sq(JUDGE_USER)}, '{{instruction}}', query), '{{output_1}}', response), '{{output_2}}', query) AS user_text FROM turns""")
def x15(spark, sf):
    conv = textops.judge_conversation(F.lit(textops.DEFAULT_JUDGE_TEMPLATE), F.col("query"), F.col("response"), F.col("query"))
    t = turns(spark, sf).withColumn("m", conv)
    return t.select("conv_id", "turn", F.col("m")[0]["content"].alias("system_text"), F.col("m")[1]["content"].alias("user_text"))


@query("x16_verdict", """WITH a AS (SELECT conv_id, turn, 'I take OUTPUT (' || ['a', 'B', 'c'][conv_id % 3 + 1] || ') : ' || text AS answer
  FROM conversations) SELECT conv_id, turn, (CASE WHEN regexp_matches(answer, '(?i)output \\(a\\)') THEN 1
  WHEN regexp_matches(answer, '(?i)output \\(b\\)') THEN 0 END)::BIGINT AS verdict FROM a""")
def x16(spark, sf):
    letter = F.element_at(F.array(F.lit("a"), F.lit("B"), F.lit("c")), (F.col("conv_id") % 3 + 1).cast("int"))
    answer = F.concat(F.lit("I take OUTPUT ("), letter, F.lit(") : "), "text")
    return load(spark, sf, "conversations").select("conv_id", "turn", big(text.verdict(answer)).alias("verdict"))


@query("x17_endpoint", r"""WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_replace(url, '^https?://([^/]+)/(.*)$', 'https://\1/v1/\2')
  WHEN 1 THEN regexp_replace(url, '^https?://([^/]+)/(.*)$', 'https://\1/openai/deployments/d/\2') ELSE url END AS u FROM pages)
  SELECT page_id, coalesce(nullif(regexp_extract(u, '^https://[^/]+/v\d+/(.+)$', 1), ''),
  nullif(regexp_extract(u, '^https://[^/]+/openai/deployments/[^/]+/(.+?)(\?|$)', 1), '')) AS endpoint FROM u""")
def x17(spark, sf):
    host = "^https?://([^/]+)/(.*)$"
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", host, "https://$1/v1/$2")).when(
        F.col("page_id") % 3 == 1, F.regexp_replace("url", host, "https://$1/openai/deployments/d/$2")
    ).otherwise(F.col("url"))
    return load(spark, sf, "pages").select("page_id", text.endpoint(url).alias("endpoint"))


@query("x18_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS token FROM embeddings")
def x18(spark, sf):
    best = F.array_position("embedding", F.array_max("embedding")) - 1
    return load(spark, sf, "embeddings").select("vec_id", big(best).alias("token"))
