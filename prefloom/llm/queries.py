"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prefloom.llm.common import table
from prefloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import secrets

    return secrets.digest(table(spark, sf_dir, "documents", "doc_id"))


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import simhash

    return simhash.digest(table(spark, sf_dir, "documents", "doc_id"))


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents", "doc_id"))


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import quality

    return quality.classify(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels"))


_OP2_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
), fine AS (
  SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op2_vantage_point_search", _OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from prefloom.llm import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _op9_sql() -> str:
    from prefloom.llm import mixing

    return mixing.twin()


@query("op9_pfair_mixing", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import mixing

    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import tokencount

    return tokencount.token_counts(table(spark, sf_dir, "documents", "doc_id"))


@query("op7_phrase_fingerprints")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import fingerprint

    return fingerprint.compare_next(table(spark, sf_dir, "documents"))


@query("op6_backoff_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import html

    return html.extract(table(spark, sf_dir, "pages", "page_id"))


def _op11_sql() -> str:
    from prefloom.llm import infill

    return infill.TWIN


@query("op11_fill_in_middle", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import infill

    return infill.digest(table(spark, sf_dir, "documents", "doc_id"))


def _op13_sql() -> str:
    from prefloom.llm import products

    return products.TWIN


@query("op13_norm_bucket_top_k", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from prefloom.llm import products

    return products.largest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _op12_sql() -> str:
    from prefloom.llm import repair

    return repair.TWIN


@query("op12_conversation_repair", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from prefloom.llm import repair

    return repair.repair(repair.damage(table(spark, sf_dir, "conversations", "conv_id")))
