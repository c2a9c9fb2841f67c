"""JSON array files read in splits: one file of any size is parsed by many tasks.

Spark's text source cuts a file into byte ranges; with ``}`` as the line separator every record ends at a place that is no escape, whatever the file looks
like. What a range does not know is whether it starts inside a string and how deep in brackets. So the file is read twice:

* the index: each range gives, for both cases (it starts outside or inside a string), its change of depth and the number of commas by their
  depth relative to its start, and whether its quotes are odd. These rows, one per range, are summed up along each file: state, depth and
  number of elements at the start of every range;
* the elements: with its start known, each range cuts its text at the commas of depth one. An element that goes on in the next range leaves in
  fragments, at most two per range, which are put together by file and place.

The place of an element in its array comes from the counts, so it does not depend on the order of rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prefloom.session import keep, ship

#: bytes whose structure is worked out at a time
PIECE = 1 << 22
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _COMMA, _OPEN, _CLOSE = b'",[]'
_STEP = np.zeros(256, np.int32)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((file, start of the range), bytes) with whole records, in the order of the file."""
    now, held, size = None, [], 0
    for batch in batches:
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        for file, start, value in zip(files, starts, batch.column("value").cast(pa.binary()).to_pylist(), strict=True):
            if ((file, start) != now or size >= PIECE) and held:
                yield now, b"".join(held)
                held, size = [], 0
            now = (file, start)
            held += (value, b"}")
            size += len(value) + 1
    if held:
        yield now, b"".join(held)


def structure(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, which of them are outside of strings, change of depth up to and with each byte)."""
    text = np.frombuffer(_ESCAPE.sub(b"__", data), np.uint8)
    outside = (np.cumsum(text == _QUOTE, dtype=np.int32) + inside) & 1 == 0
    return text, outside, np.cumsum(_STEP[text] * outside, dtype=np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, odd, depth, commas = None, False, [0, 0], [Counter(), Counter()]

    def row() -> pa.RecordBatch:
        levels = [[(int(k), int(n)) for k, n in sorted(c.items())] for c in commas]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.map_(pa.int64(), pa.int64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, odd, depth, *levels), kinds, strict=True)], names=["file", "start", "odd", "depth", "outer", "inner"])

    for at, data in _pieces(batches):
        if at != now:
            if now is not None:
                yield row()
            now, odd, depth, commas = at, False, [0, 0], [Counter(), Counter()]
        for case in (0, 1):
            text, outside, change = structure(data, bool(case) ^ odd)
            level, count = np.unique(depth[case] + change[(text == _COMMA) & outside], return_counts=True)
            commas[case].update(dict(zip(level.tolist(), count.tolist(), strict=True)))
            depth[case] += int(change[-1])
        odd ^= bool((text == _QUOTE).sum() & 1)
    if now is not None:
        yield row()


def _elements(batches: Iterator[pa.RecordBatch], starts: dict) -> Iterator[pa.RecordBatch]:
    """Rows (file, idx, start, whole, value); ``starts`` is filled with the state of each range as its rows come by."""
    now, inside, depth, idx = None, False, 0, 0
    held: list[bytes] | None = None  # the open element, None outside of the array
    first = False  # the open element began before this range
    rows: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        nonlocal rows, size
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "idx", "start", "whole", "value"])
        rows, size = [], 0
        return made

    def give(whole: bool) -> None:
        nonlocal size
        value = b"".join(held)
        rows.append((now[0], idx, now[1], whole, value.decode("utf-8", "replace")))
        size += len(value)

    for at, data in _pieces(batches):
        if at != now:
            if held is not None:
                give(False)
            now = at
            inside, depth, idx = starts.pop(at)
            first = depth > 0
            held = [] if first else None
        text, outside, change = structure(data, inside)
        level = depth + change
        step = _STEP[text] * outside
        cuts = np.flatnonzero(outside & (((text == _COMMA) & (level == 1)) | ((step == 1) & (level == 1)) | ((step == -1) & (level == 0))))
        start = 0
        for cut, sign in zip(cuts.tolist(), text[cuts].tolist(), strict=True):
            if sign == _COMMA or sign == _CLOSE:
                if held is not None:
                    held.append(data[start:cut])
                    give(not first)
                    idx, first = idx + 1, False
                held = [] if sign == _COMMA else None
            elif sign == _OPEN:
                held, first = [], False
            start = cut + 1
        if held is not None:
            held.append(data[start:])
        inside ^= bool((text == _QUOTE).sum() & 1)
        depth += int(change[-1])
        if size >= PIECE:
            yield out()
    if held is not None:
        give(False)
    if rows:
        yield out()


def read_elements(spark: SparkSession, path: str | list[str], glob: str = "*.json") -> DataFrame:
    """``file, idx, value``: the elements of JSON array files as JSON text, with their places from 0. Blank arrays have none; elements may be of any kind."""
    ship(spark)
    text = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    schema = "file string, start bigint, odd boolean, depth array<bigint>, outer map<bigint,bigint>, inner map<bigint,bigint>"
    index = keep(pieces.mapInArrow(_index, schema), "index")
    # one row per range of a file
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = index.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2)
    state = state.withColumn("change", F.col("depth")[F.col("inside").cast("int")]).withColumn("commas", F.when(F.col("inside") == 0, F.col("outer")).otherwise(F.col("inner")))
    state = state.withColumn("level", F.coalesce(F.sum("change").over(before), F.lit(0)))
    state = state.withColumn("count", F.coalesce(F.element_at("commas", 1 - F.col("level")), F.lit(0)))
    state = state.withColumn("idx", F.coalesce(F.sum("count").over(before), F.lit(0))).select("file", "start", F.col("inside").cast("int").alias("inside"), "level", "idx")
    state = keep(state, "ranges")
    # a row of some bytes for each range of a file, 128 MB as a rule: a fixed small part of the input; the broadcast keeps the pieces in order
    known = pieces.join(F.broadcast(state), ["file", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts: dict = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("file", "start", "inside", "level", "idx")]
                for file, start, inside, level, idx in dict.fromkeys(zip(*columns, strict=True)):
                    starts[file, start] = (bool(inside), level, idx)
                yield batch

        yield from _elements(noted(), starts)

    cut = keep(known.mapInArrow(run, "file string, idx bigint, start bigint, whole boolean, value string"), "elements")
    parts = F.sort_array(F.collect_list(F.struct("start", "value")))
    joined = cut.filter("not whole").groupBy("file", "idx").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "").alias("value"))
    return cut.filter("whole").select("file", "idx", "value").union(joined).filter(F.trim(F.translate("value", "\t\n\r", "   ")) != "")
