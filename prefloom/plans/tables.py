"""The given tables bound to the engine's inputs, as DataFrames and as the matching SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import grammar, text
from prefloom.functions.common import big
from prefloom.operators.ordering import positions
from prefloom.plans.registry import load
from prefloom.session import spread

METRICS = ["holistic_reward", "readability", "response_length", "grammar_errors", "error_rate"]


def sq(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


EOS = text.token_id(".")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "doc_id")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows: ``conv_id, turn, query, response``."""
    conv = load(spark, sf, "conversations")
    user = conv.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    answer = conv.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return user.join(answer, ["conv_id", "turn"])


TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS query, a.text AS response FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def token_turns(spark: SparkSession, sf: str) -> DataFrame:
    """turns as token ids: ``conv_id, turn, query_ids, response_ids``."""
    return turns(spark, sf).select(
        "conv_id", "turn", text.token_ids(text.tokens("query")).alias("query_ids"),
        text.token_ids(text.tokens("response")).alias("response_ids"),
    )


def sql_ids(c: str) -> str:
    return (f"list_transform(regexp_extract_all({c}, {sq(text.TOKEN)}), "
            "lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % 50000 + 10)::INT)")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """documents as runs: run = source, idx = position by doc_id inside the source."""
    docs = documents(spark, sf)
    ranked = positions(docs.select("doc_id", F.col("source").alias("run")), ["doc_id"], ["run"])
    measured = docs.select(
        "doc_id",
        F.col("text").alias("query"),
        F.col("text").alias("generation"),
        F.log(F.lit(1.0) + F.col("n_chars")).alias("holistic_reward"),
        text.fk_grade(text.text_counts("text")).alias("readability"),
        big(text.token_count("text")).alias("response_length"),
        big(grammar.match_count("text")).alias("grammar_errors"),
    ).withColumn("error_rate", F.try_divide(F.col("grammar_errors").cast("double"), F.col("response_length").cast("double")))
    return ranked.join(measured, "doc_id")


def sql_count(pattern: str, c: str = "text") -> str:
    return f"len(regexp_extract_all({c}, {sq(pattern)}))"


TOKEN_TURNS = TURNS + f""", token_turns AS (SELECT conv_id, turn, {sql_ids('query')} AS query_ids,
  {sql_ids('response')} AS response_ids FROM turns)"""
SQL_WORDS = f"{sql_count(text.WORD)}::DOUBLE"
SQL_SENTENCES = f"greatest({sql_count(r'[^.!?\s][^.!?]*')}, 1)::DOUBLE"
SQL_SYLLABLES = (
    f"({sql_count(text.VOWELS, 'lower(text)')} + "
    f"len(list_filter(regexp_extract_all(lower(text), {sq(text.WORD)}), "
    f"lambda w: len(regexp_extract_all(w, {sq(text.VOWELS)})) = 0)))::DOUBLE"
)
SQL_GRAMMAR = "(" + " + ".join(sql_count(p) for _, p in grammar.RULES) + ")"
SQL_FK = "coalesce(0.39 * (w / s) + 11.8 * (y / nullif(w, 0)) - 15.59, 0.0)"
SQL_FRE = "coalesce(206.835 - 1.015 * (w / s) - 84.6 * (y / nullif(w, 0)), 0.0)"

RUNS = f"""
counted AS (SELECT doc_id, source AS run, text, n_chars, {SQL_WORDS} AS w, {SQL_SENTENCES} AS s, {SQL_SYLLABLES} AS y,
  {sql_count(text.TOKEN)}::BIGINT AS response_length, {SQL_GRAMMAR}::BIGINT AS grammar_errors FROM documents),
runs AS (SELECT doc_id, run, (row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1)::BIGINT AS idx, text AS query,
  text AS generation, ln(1.0::DOUBLE + n_chars) AS holistic_reward, {SQL_FK} AS readability, response_length, grammar_errors,
  grammar_errors::DOUBLE / nullif(response_length, 0)::DOUBLE AS error_rate FROM counted)"""

LONG_RUNS = "long_runs AS (" + " UNION ALL ".join(
    f"SELECT run, idx, holistic_reward AS h, '{m}' AS metric, {m}::DOUBLE AS v FROM runs" for m in METRICS
) + ")"
