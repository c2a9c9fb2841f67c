"""Readers and writers for the file layouts of prompts, runs, requests and results."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.operators.compare import dedup_first
from prefloom.sources.arrays import read_elements

QA_SCHEMA = "text string, question string, answer string, passages string"
GENERATION_COLUMNS = {
    "qa": "query string, generation string, holistic_reward double, factuality_rate double, verbosity_rate double, "
          "completeness_reward double, response_length bigint",
    "mt": "query string, generation string, holistic_reward double, readability double, language_confidence double, "
          "grammar_errors bigint, error_rate double, response_length bigint",
}


def write_json_arrays(df: DataFrame, path: str) -> None:
    """Every part file becomes one JSON array, written row by row."""

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [(mark if i == 0 else ",") + v for i, v in enumerate(b["value"])]})
                mark = ","
        yield pd.DataFrame({"value": ["]" if mark == "," else "[]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInPandas(lines, "value string").write.text(path)


def read_qa(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """``folder/split.json`` (one JSON array, read in ranges) as ``prompt, metadata``; answers and passages stay JSON text."""
    raw = read_elements(spark, f"{folder}/{split}.json", "*").select(F.from_json("value", QA_SCHEMA).alias("e")).select("e.*")
    return raw.select(
        F.col("text").alias("prompt"),
        F.struct(F.col("text").alias("prompt"), F.col("answer").alias("references"), "passages", "question").alias("metadata"),
    )


def read_parallel(spark: SparkSession, path: str, src: str = "es", tgt: str = "en", fmt: str = "parquet") -> DataFrame:
    """Sentence pairs from a table with a ``translation`` struct."""
    reader = spark.read.format(fmt)
    if fmt == "json":
        reader = reader.schema(f"translation struct<{src}:string,{tgt}:string>")
    return reader.load(path).select(F.col(f"translation.{src}").alias(src), F.col(f"translation.{tgt}").alias(tgt))


def read_runs(spark: SparkSession, folder: str, task: str = "mt") -> DataFrame:
    """``folder/*.json``: one array per run, each read in ranges by many tasks; run = name up to the first ``.json``, idx = place in the array."""
    rows = read_elements(spark, folder)
    name = F.split(F.url_decode(F.element_at(F.split("file", "/"), -1)), r"\.json")[0]
    return rows.select(name.alias("run"), "idx", F.from_json("value", GENERATION_COLUMNS[task]).alias("g")).select("run", "idx", "g.*")


def write_runs(df: DataFrame, folder: str) -> None:
    """``folder/<run>.json`` for each run: one JSON array in the order of ``idx``. Such a file is one sequence, which one task writes; runs beyond the
    size of a file belong in :func:`write_run_table`. Names of runs pass the driver, one for each file."""
    spark = df.sparkSession
    names = [r["run"] for r in df.select("run").distinct().orderBy("run").collect()]
    numbers = spark.createDataFrame(list(enumerate(names)), "number int, run string")
    fields = [c for c in df.columns if c not in ("run", "idx")]
    rows = df.join(F.broadcast(numbers), "run").select("number", "idx", F.to_json(F.struct(*fields)).alias("value"))

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "["
        for b in batches:
            if len(b):
                yield pd.DataFrame({"value": [(mark if i == 0 else ",") + v for i, v in enumerate(b["value"])]})
                mark = ","
        if mark == ",":
            yield pd.DataFrame({"value": ["]"]})

    parts = f"{folder}/_parts"
    dealt = rows.repartitionById(max(1, len(names)), "number").sortWithinPartitions("idx")
    dealt.select("value").mapInPandas(lines, "value string").write.text(parts)
    # the files of the parts get the names of their runs
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(parts).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path(parts)):
        if found := re.match(r"part-(\d+)-", status.getPath().getName()):
            if not files.rename(status.getPath(), path(f"{folder}/{names[int(found[1])]}.json")):
                raise OSError(f"{folder}/{names[int(found[1])]}.json can't be written")
    files.delete(path(parts), True)


def write_run_table(df: DataFrame, path: str) -> None:
    df.write.partitionBy("run").parquet(path)


def write_run_lines(df: DataFrame, path: str) -> None:
    """One folder per run of JSON lines that carry ``idx``, so a run of any size is written and read in splits."""
    df.write.partitionBy("run").json(path)


def read_run_lines(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """``run, idx`` and the given columns of :func:`write_run_lines`."""
    rows = spark.read.schema(f"idx bigint, {columns}, run string").json(path)
    return rows.select("run", *[c for c in rows.columns if c != "run"])


def read_run_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as ``request`` (the line without its metadata, a variant's JSON text) and ``metadata``."""
    return split_requests(spark.read.text(path))


def _is_object(variant: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines that are neither blank nor JSON objects, for an output of their own."""
    return lines.filter((F.trim("value") != "") & ~_is_object_text("value"))


def _is_object_text(c: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def split_requests(lines: DataFrame) -> DataFrame:
    """Detach the metadata of request lines in a column ``value``; works on tables and on streams. Lines that are no JSON objects are left to
    :func:`bad_lines`."""
    parsed = lines.filter(F.trim("value") != "").withColumn("_v", F.try_parse_json("value")).filter(_is_object("_v"))
    fields = F.variant_get("_v", "$", "map<string,variant>")
    body = F.map_filter(fields, lambda k, _: k != "metadata")
    return parsed.select(F.to_json(body).alias("request"), F.to_json(fields["metadata"]).alias("metadata"))


def results_path(requests_path: str) -> str:
    """Default output name: ``x.jsonl`` → ``x_results.jsonl``."""
    return requests_path.replace(".jsonl", "_results.jsonl")


def result_line(request: Column, response: Column, metadata: Column) -> Column:
    """``[request, response]`` or, with non-empty metadata, ``[request, response, metadata]`` as JSON text."""
    empty = metadata.isNull() | metadata.isin("", "{}", "[]", "null", "0", "false", '""')
    tail = F.when(empty, F.lit("]")).otherwise(F.concat(F.lit(", "), metadata, F.lit("]")))
    return F.concat(F.lit("["), request, F.lit(", "), response, tail)


def write_results(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append result lines from JSON text columns ``request, response, metadata``."""
    df.select(result_line(F.col("request"), F.col("response"), F.col("metadata")).alias("value")).write.mode(mode).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines as ``run_a, run_b, idx, failed, answer, verdict``; the answer is the tool call's arguments or the
    message content. A failed line has a list of errors instead of a response and gives a null answer."""
    v = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v IS NOT NULL")
    message = "$[1].choices[0].message"
    answer = F.coalesce(
        F.try_variant_get("v", f"{message}.tool_calls[0].function.arguments", "string"),
        F.try_variant_get("v", f"{message}.content", "string"),
    )
    return v.select(
        F.try_variant_get("v", "$[2].name_a", "string").alias("run_a"),
        F.try_variant_get("v", "$[2].name_b", "string").alias("run_b"),
        F.try_variant_get("v", "$[2].id", "bigint").alias("idx"),
        F.try_variant_get("v", "$[1].choices", "variant").isNull().alias("failed"),
        answer.alias("answer"),
    ).withColumn("verdict", text.verdict("answer"))


def tree_lines(summary: DataFrame, rates: DataFrame) -> DataFrame:
    """One JSON object per run: ``{"<metric>-Mean": …, "<run b>": {metric: {…}}, "<itself>": "*", "Avg.": {…}}``."""
    def inner(j: Column) -> Column:
        return F.regexp_replace(F.to_json(j), r"^\{|\}$", "")

    def as_map(key: Column, value: Column) -> Column:
        entries = F.collect_list(F.struct(key.alias("k"), value.alias("v")))
        by_key = F.array_sort(entries, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        return F.map_from_entries(by_key)

    means = summary.groupBy("run").agg(inner(as_map(F.concat("metric", F.lit("-Mean")), F.col("mean"))).alias("means"))
    cell = rates.groupBy(F.col("run_a").alias("run"), "run_b").agg(
        as_map(F.col("metric"), F.struct("win_rate", "holistic_reward_inconsistent")).alias("cell")
    )
    cells = cell.groupBy("run").agg(inner(as_map(F.col("run_b"), F.col("cell"))).alias("cells"))
    avg = rates.groupBy(F.col("run_a").alias("run"), "metric").agg(F.avg("win_rate").alias("a"))
    avg = avg.groupBy("run").agg(F.to_json(as_map(F.col("metric"), F.col("a"))).alias("avg"))
    joined = means.join(cells, "run", "left").join(avg, "run", "left")
    itself = F.to_json(F.create_map("run", F.lit("*")))
    body = F.concat_ws(
        ",", "means", F.regexp_replace(itself, r"^\{|\}$", ""), "cells", F.concat(F.lit('"Avg.":'), F.coalesce("avg", F.lit("null")))
    )
    return joined.select("run", F.concat(F.lit("{"), body, F.lit("}")).alias("tree"))


def write_tree(summary: DataFrame, rates: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The comparison tree as JSON lines, one ``{"run": …, "results": {…}}`` per run."""
    lines = tree_lines(summary, rates)
    name = F.regexp_replace(F.to_json(F.array("run")), r"^\[|\]$", "")
    lines.select(F.concat(F.lit('{"run":'), name, F.lit(',"results":'), "tree", F.lit("}")).alias("value")).write.mode(mode).text(path)


def write_generations(df: DataFrame, path: str, order: str, mode: str = "errorifexists") -> None:
    """First generation per query, sorted by query, as JSON lines."""
    dedup_first(df, "query", [order]).drop(order).write.mode(mode).json(path)


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], use_cache: bool = False) -> DataFrame:
    """Write ``build()`` to a new folder and read it back; an existing one is an error unless ``use_cache`` is set."""
    if use_cache:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # only a missing path means that there is nothing cached yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
