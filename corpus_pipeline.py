"""From raw documents to packed training sequences.

Each stage takes the documents that the one before has kept and returns the columns of ``documents`` again, the last one the packed pieces.
Documents that the quality classifier rejects go; of each group of near duplicates (five-word shingles, a shared part of 0.8 or more) one document stays;
secrets are replaced by marks in the text; the rest is put into an order that follows the target weights of
the sources, by the square root of their sizes; the last stage packs it into sequences that follow this order. Stages hand on stored tables: the
mixture is written in its order, and the last stage reads the place of a document from where it is stored, by the number of its file and its row there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm import mixing, packing, quality, secrets, simhash
from prefloom.llm.common import table
from prefloom.session import keep, ship


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3; learned from the labelled ones among them."""
    ship(spark)
    measured = keep(quality.measure(docs), "statistics")
    return quality.accept(docs, quality.fit(measured, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    ship(spark)
    return simhash.drop_near(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by marks; ``n_chars`` follows the text."""
    ship(spark)
    clean = secrets.find_secrets(docs, redact=True)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture."""
    return mixing.mixed_order(docs)


def stored_places(docs: DataFrame) -> DataFrame:
    """A stored table with ``file_number, file_name, row_index``: the order in which its rows were written."""
    at = docs.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("row_index"))
    # tasks write part-<number of the task>; a name of another kind stands for itself
    number = F.expr("try_cast(regexp_extract(file_name, '^part-([0-9]+)', 1) AS bigint)")
    return at.withColumn("file_number", F.coalesce(number, F.lit(-1).cast("bigint")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of equal length go to the sequences in the order in which the documents are stored, and sequences are numbered by the first place they
    hold. Documents that are no stored table have no order yet: they are mixed and stored first."""
    ship(spark)
    try:
        placed = stored_places(docs)
    except AnalysisException:
        placed = stored_places(keep(mix_sources(spark, docs, sf_dir), "mixing"))
    order = ["file_number", "file_name", "row_index"]
    return packing.place(keep(packing.tokenize(placed, also=order), "pieces"), first=order)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_distinct),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

# fitted scores, XXH64 bit counts and tokenizers are beyond SQL; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
