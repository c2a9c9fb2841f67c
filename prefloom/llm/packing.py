"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

A document is its tokens and one end token. One that is longer than the capacity is cut into pieces of that capacity, its
first piece taking the rest. Pieces that fill a sequence get one each; the others are packed.

The packing is a bulk-synchronous best fit. Documents are sorted by length, and since lengths lie between 1 and the
capacity, the sorted order is a list of runs (length, count); a run's members are told apart by their rank, which is
computed by distributed counts. Gaps of open sequences are likewise runs (gap, first sequence, count). A sweep goes from
long to short: the documents of a run look for the successor of their length among the gaps; when several want the same gap, the one
with rank r takes the gap with rank r; gaps are updated and the sweep goes on with what is left of the run, opening new
sequences when no gap is left. A step moves a whole run, so the sweeps work on at most ``capacity`` runs
of documents however many documents there are, and only those counts reach the driver. Their outcome, intervals of
ranks, is joined back to the pieces: by length, rank within the interval.

Cases: a null text counts as empty and so is its end token alone; repeated rows are packed each for itself; an empty table
gives an empty result. Further columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import pieces, text_of
from prefloom.operators.ordering import ROWS_PER_PART, positions
from prefloom.session import keep

CAPACITY = 2048
END_ID = 0
#: rows of one length that are ranked in one task
RANKED_TOGETHER = 1_000


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids of the tokenizer file ``path``, by tiktoken, which is several times as fast as the library that the file is
    made for and gives the same ids: ranks are the ids of the vocabulary, special tokens are the file's."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    signs = _byte_signs()
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(signs[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: texts with a longer run of white space are read by the library of the file: the pattern's look-ahead makes tiktoken keep a place to
#: return to for each sign of such a run, and it gives up at somewhere between 500,000 and 1,500,000
LONGEST_SPACE = 100_000
_SPACES = re.compile(r"\s+")


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> list[int]:
    """Ids of a text without the end token."""
    # maximal runs, each of which is passed once
    if len(text) >= LONGEST_SPACE and any(run.end() - run.start() >= LONGEST_SPACE for run in _SPACES.finditer(text)):
        return _library(path).encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


# Fixed value: how byte-level vocabularies of this kind split text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others
    from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def tokenize(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, also: Sequence[str] = ()) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32`` and the columns ``also`` of its document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows, out = batch.column(key), [], []
            for at, t in enumerate(text_of(batch, text)):
                ids = ids_of(t, path)
                ids.append(END_ID)
                data = np.array(ids, dtype="<u4").tobytes()
                n = len(ids)
                cut = n % capacity or capacity  # the rest stands first
                start, piece = 0, 0
                while start < n:
                    rows.append(at)
                    out.append((piece, start, cut - start, zlib.crc32(data[4 * start : 4 * cut])))
                    start, cut, piece = cut, cut + capacity, piece + 1
            if rows:
                columns = list(zip(*out, strict=True))
                of = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(of), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:]), *(batch.column(c).take(of) for c in also)],
                    names=[key, "piece", "start", "length", "ids_crc32", *also],
                )

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *also)]
    return df.select(key, text, *also).mapInArrow(run, ", ".join([kinds[0], "piece int, start bigint, length bigint, ids_crc32 bigint", *kinds[1:]]))


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """Best fit on runs: yields (length, first rank, count, first sequence, offset), which says that the documents
    of that length with ranks from ``first rank`` on go to as many sequences from ``first sequence`` on."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes = np.zeros(capacity + 1, dtype=bool)  # which gaps there are
    made = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap:
            gaps.setdefault(gap, []).append((first, count))
            sizes[gap] = True

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            fit = int(np.argmax(sizes[length:])) + length
            if sizes[fit]:
                first, count = gaps[fit].pop()
                taken = min(count, left)
                if taken < count:
                    gaps[fit].append((first + taken, count - taken))
                if not gaps[fit]:
                    sizes[fit] = False
                yield length, rank, taken, first, capacity - fit
                put(fit - length, first, taken)
            else:
                # as many of this length as fit go into each new sequence, the last one may hold fewer
                each = capacity // length
                full, rest = divmod(left, each)
                for k in range(each if full else 0):
                    yield length, rank + k * full, full, made, k * length
                put(capacity - each * length, made, full) if full else None
                for k in range(rest):
                    yield length, rank + each * full + k, 1, made + full, k * length
                if rest:
                    put(capacity - rest * length, made + full, 1)
                made += full + (rest > 0)
                taken = left
            left -= taken
            rank += taken


def ranks(rows: DataFrame, by: str, order: list[str], largest: int) -> DataFrame:
    """``rows`` with ``rank`` (from 0) within each value of ``by``. A value with very many rows is cut into parts by a
    hash of ``order``, parts are ranked for themselves and their counts are summed up, so no task ranks a whole
    hot value."""
    parts = max(1, -(-largest // RANKED_TOGETHER))
    cut = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    sums = cut.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = cut.withColumn("_rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)) - 1)
    return inside.join(sums, [by, "_part"]).withColumn("rank", F.col("_before") + F.col("_rank")).drop("_part", "_rank", "_before")


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``."""
    return place(keep(tokenize(df, key, text, path, capacity), "pieces"), key, capacity)


def place(rows: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, first: Sequence[str] = ()) -> DataFrame:
    """:func:`pack` for the stored pieces ``rows``. With ``first``, columns that order the documents, pieces of one length go to the sequences
    in that order, and sequences are numbered by the first piece they hold."""
    spark = rows.sparkSession
    # at most ``capacity`` counts reach the driver
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [key, "piece", "start", "ids_crc32"]
    if first:
        total = sum(counts.values())
        ranked = positions(rows, [*first, *order], ["length"], "rank", max(RANKED_TOGETHER, min(ROWS_PER_PART, total // 64)))
    else:
        ranked = ranks(rows, "length", order, max(counts.values(), default=0))
    # a run of documents meets each run of gaps once: the intervals follow from the lengths, not from the documents
    found = list(sweep(counts, capacity))
    frames = [spark.createDataFrame(part, "_length bigint, _first bigint, _count bigint, _sequence bigint, offset bigint") for part in pieces(found, 100_000)]
    if not frames:
        frames = [spark.createDataFrame([], "_length bigint, _first bigint, _count bigint, _sequence bigint, offset bigint")]
    places = frames[0]
    for f in frames[1:]:
        places = places.union(f)
    if first and found:
        # of the pieces that open sequences, which are those at offset 0 and all with them, one sequence holds consecutive ranks
        opened: dict[int, tuple[int, int]] = {}
        for length, rank, count, _, offset in found:
            if not offset:
                opened.setdefault(length, (rank, count))
        opening = spark.createDataFrame([(n, r, c, capacity // n) for n, (r, c) in opened.items()], "length bigint, _from bigint, _full bigint, _each bigint")
        inside = F.expr("rank >= _from and rank < _from + _full * _each")
        dealt = F.expr("_from + (rank - _from) % _each * _full + (rank - _from) div _each")
        ranked = ranked.join(opening, "length", "left").withColumn("rank", F.when(inside, dealt).otherwise(F.col("rank"))).drop("_from", "_full", "_each")
    # ranks of one length are cut into steps, so that a piece meets only the intervals of its own step
    step = 1024
    places = places.withColumn("_step", F.explode(F.sequence(F.expr(f"_first div {step}"), F.expr(f"(_first + _count - 1) div {step}"))))
    on = [F.col("length") == F.col("_length"), F.expr(f"rank div {step}") == F.col("_step"), F.col("rank") >= F.col("_first"), F.col("rank") < F.col("_first") + F.col("_count")]
    joined = ranked.join(places, on)
    columns = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = joined.withColumn("sequence_id", F.col("_sequence") + F.col("rank") - F.col("_first"))
    if not first:
        return packed.select(columns)
    packed = keep(packed.select(*columns, *first), "packed")
    heads = keep(packed.groupBy("sequence_id").agg(F.min(F.struct(*first, "piece")).alias("_head")), "heads")
    numbers = positions(heads, ["_head", "sequence_id"], out="_number", rows=max(RANKED_TOGETHER, min(ROWS_PER_PART, heads.count() // 64))).select("sequence_id", "_number")
    return packed.join(numbers, "sequence_id").withColumn("sequence_id", F.col("_number")).select(columns)
