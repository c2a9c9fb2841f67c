"""Fill-in-the-middle over texts in seekable compressed frames.

A stored text is a row of independent zstandard frames of ``UNITS`` code points each and the cumulative number of code points after each
frame. A place in the text is found by a binary search in these numbers, so a span is read by decompressing the frames that it
touches. The cut of a text into prefix, middle and suffix is worked out by Spark from the count and the key alone; the reordered text is
again written frame by frame, and digests stream over ordered frames, one of which is held at a time. The original is rebuilt from the output: its
marks are searched in the frames and the spans between them are read in the order of the original.

Steps, each of which may be used alone: :func:`store` (texts to frames), :func:`plan` (form and cuts, columns only), :func:`infill` (the
output texts or, with ``digests``, their digests), :func:`digest` (all of it).

Cases: a null text is an empty one and stays plain, as does one that holds a mark already; a null key counts as an empty text in the
draw; equal keys draw the same numbers; repeated rows have a row each; an empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.common import text_of
from prefloom.session import keep

#: code points of a frame
UNITS = 1 << 16
#: a batch of results is handed on when its frames or texts have so many bytes
HANDED_ON = 1 << 24
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)


@dataclass(frozen=True)
class Draw:
    """Seed, and of 100 texts how many are reordered and how many of those have their suffix first."""

    seed: int = 1
    reordered: int = 90
    suffix_first: int = 20


@lru_cache(maxsize=1)
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


class Frames:
    """A text as independent frames; ``ends[k]`` is the number of code points up to the end of frame k."""

    def __init__(self, frames: list[bytes], ends: list[int]) -> None:
        self.frames, self.ends = frames, ends

    @classmethod
    def of(cls, parts: Iterable[str], units: int = UNITS) -> Frames:
        """Frames of a text that comes in parts; no more than a frame and a part are held."""
        made = cls([], [])
        held: list[str] = []
        room = units
        for part in parts:
            at = 0
            while at < len(part):
                piece = part[at : at + room]
                held.append(piece)
                at += len(piece)
                room -= len(piece)
                if not room:
                    made._close(held, units)
                    held, room = [], units
        if held:
            made._close(held, units - room)
        return made

    def _close(self, held: list[str], count: int) -> None:
        self.frames.append(_codec()[0].compress("".join(held).encode("utf-8")))
        self.ends.append(len(self) + count)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def span(self, start: int = 0, end: int | None = None) -> Iterator[str]:
        """The code points from ``start`` to ``end``, frame by frame; no other frame is decompressed."""
        end = len(self) if end is None else end
        k = bisect_right(self.ends, start)
        while start < end:
            first = self.ends[k - 1] if k else 0
            text = _codec()[1].decompress(self.frames[k]).decode("utf-8")
            yield text if start == first and end >= self.ends[k] else text[start - first : end - first]
            start = self.ends[k]
            k += 1

    def find(self, mark: str, start: int = 0) -> int:
        """Place of the first ``mark`` at or behind ``start``, also where it lies across frames; -1 without one."""
        at, tail = start, ""
        for text in self.span(start):
            text = tail + text
            found = text.find(mark)
            if found >= 0:
                return at + found
            tail = text[-(len(mark) - 1) :]
            at += len(text) - len(tail)
        return -1


def sha256(parts: Iterable[str]) -> str:
    running = hashlib.sha256()
    for part in parts:
        running.update(part.encode("utf-8"))
    return running.hexdigest()


def reordered(text: Frames, form: str, first: int, second: int) -> Iterator[str]:
    """The parts of the output: ``first`` and ``second`` are the ends of prefix and middle."""
    if form == "plain":
        yield from text.span()
        return
    spans = {PREFIX: (0, first), MIDDLE: (first, second), SUFFIX: (second, len(text))}
    for mark in (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE):
        yield mark
        yield from text.span(*spans[mark])


def restored(output: Frames, form: str) -> Iterator[str]:
    """The parts of the original text, found in the output by its marks."""
    if form == "plain":
        yield from output.span()
        return
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    starts, at = [], 0
    for mark in order:
        at = output.find(mark, at) + len(mark)
        starts.append(at)
    ends = [starts[1] - len(order[1]), starts[2] - len(order[2]), len(output)]
    spans = dict(zip(order, zip(starts, ends, strict=True), strict=True))
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from output.span(*spans[mark])


def _handed_on(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterator[tuple[int, tuple]]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of ``work``, each with its number of bytes, in batches of bounded size."""
    rows: list[tuple] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for n, row in work(batch):
            rows.append(row)
            size += n
            if size >= HANDED_ON:
                yield batch_of()
                rows, size = [], 0
    if rows:
        yield batch_of()


def store(df: DataFrame, key: str = "doc_id", text: str = "text", units: int = UNITS) -> DataFrame:
    """``key, n, marked, frames, ends``: the texts in frames, their code points, and whether they hold a mark already."""
    kind = df.schema[key].dataType

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        keys = batch.column("k")
        for at, t in enumerate(text_of(batch, "t")):
            made = Frames.of([t], units)
            yield sum(map(len, made.frames)) + 64, (keys[at].as_py(), len(t), any(m in t for m in MARKS), made.frames, made.ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(kind), pa.int64(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        yield from _handed_on(batches, work, [key, "n", "marked", "frames", "ends"], kinds)

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, n bigint, marked boolean, frames array<binary>, ends array<bigint>")


def plan(stored: DataFrame, key: str = "doc_id", draw: Draw = Draw()) -> DataFrame:
    """``stored`` with ``form``, ``first`` and ``second``: the ends of prefix and middle, null for plain texts."""
    digits = F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)

    def number(k: int) -> Column:
        return F.conv(F.substring("_digits", 8 * k - 7, 8), 16, 10).cast("bigint")

    plain = (F.col("n") == 0) | F.col("marked") | (number(3) % 100 >= draw.reordered)
    form = F.when(plain, "plain").when(number(4) % 100 < draw.suffix_first, "spm").otherwise("psm")
    one, two = number(1) % (F.col("n") + 1), number(2) % (F.col("n") + 1)
    cut = stored.withColumn("_digits", digits).withColumn("form", form)
    cut = cut.withColumn("first", F.when(F.col("form") != "plain", F.least(one, two))).withColumn("second", F.when(F.col("form") != "plain", F.greatest(one, two)))
    return cut.drop("_digits")


def infill(planned: DataFrame, key: str = "doc_id", units: int = UNITS, digests: bool = False) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars`` and ``output``, the whole reordered text, or with ``digests`` the columns ``output_sha256`` and
    ``restored_sha256``: of the output, and of the original as it is rebuilt from the output and the form."""
    kind = planned.schema[key].dataType
    results = ["output_sha256", "restored_sha256"] if digests else ["output"]

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        names = ("k", "n", "form", "first", "second", "frames", "ends")
        columns = [batch.column(c) for c in names]
        for at in range(batch.num_rows):
            k, n, form, first, second, frames, ends = (c[at].as_py() for c in columns)
            parts = reordered(Frames(frames, ends), form, first, second)
            front = (k, n, form, first, None if first is None else second - first)
            if digests:
                output = Frames.of(parts, units)
                yield 256, (*front, sha256(output.span()), sha256(restored(output, form)))
            else:
                text = "".join(parts)
                yield 4 * len(text) + 64, (*front, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(results)]
        yield from _handed_on(batches, work, [key, "n", "form", "prefix_chars", "middle_chars", *results], kinds)

    rows = planned.select(F.col(key).alias("k"), "n", "form", "first", "second", "frames", "ends")
    made = ", ".join(f"{c} string" for c in results)
    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {made}")


def restore(outputs: DataFrame, key: str = "doc_id", form: str = "form", output: str = "output") -> DataFrame:
    """``key, text``: the original texts, from outputs and forms alone."""
    kind = outputs.schema[key].dataType

    def work(batch: pa.RecordBatch) -> Iterator[tuple[int, tuple]]:
        for k, f, t in zip(batch.column("k").to_pylist(), batch.column("f").to_pylist(), text_of(batch, "t"), strict=True):
            text = "".join(restored(Frames.of([t]), f or "plain"))
            yield 4 * len(text) + 64, (k, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _handed_on(batches, work, [key, "text"], [to_arrow_type(kind), pa.string()])

    rows = outputs.select(F.col(key).alias("k"), F.col(form).alias("f"), F.col(output).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, text string")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", draw: Draw = Draw(), units: int = UNITS) -> DataFrame:
    """Form, cuts and digests of all texts. The frames are stored in the shared folder, so a lost executor repeats the texts of its tasks only."""
    return infill(plan(keep(store(df, key, text, units), "frames"), key, draw), key, units, digests=True)


#: the same in SQL
TWIN = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), d AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS c2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS h4 FROM t
), f AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN a END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN b - a END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
