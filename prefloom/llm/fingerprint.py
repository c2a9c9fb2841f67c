"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. A round of parsing joins repeats of one sign into one symbol and then makes labels by deterministic
coin tossing: a symbol's label becomes twice the lowest bit place in which it differs from its left neighbour, plus that
bit, repeated until labels are below 6. A phrase starts at each local maximum of the labels; its name is a hash of its
symbols. Names are the symbols of the next round. Whether a phrase starts somewhere depends on a few neighbours only, so
equal substrings get equal phrases inside, wherever they stand, at every level of the hierarchy.

The fingerprint is a bottom-k sketch of the set of names of one level: the ``KEEP`` smallest 32-bit hashes, in hex. The likeness of
two fingerprints is the usual estimate of the shared part of both sets (exact while both hold fewer names).

Cases: a null text counts as empty; two empty texts are alike (1), an empty and another one are not (0). Rows with one key follow each
other in the order of a hash of their texts, null keys stand first. A single row is its own next one. An empty table gives an
empty result; further columns are not read. A text is parsed as one array, so its length is bounded by a task's memory only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import text_of
from prefloom.session import keep

LEVELS = 2
KEEP = 48
#: code points that are parsed together
CHUNK = 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= _STEPS[0]
    x ^= x >> np.uint64(27)
    x *= _STEPS[1]
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _ODD, np.uint64))


def _tossed(bits: int) -> np.ndarray:
    """Label of (left neighbour, own) for labels below 2**bits, as a flat table."""
    left, own = np.divmod(np.arange(1 << 2 * bits), 1 << bits)
    differ = left ^ own
    low = np.where(differ == 0, 0, np.bitwise_count((differ & -differ) - 1))
    return (2 * low + (own >> low & 1)).astype(np.uint8)


_POWERS = _powers(1 << 12)
_TABLE = _tossed(7)


def toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6 such that neighbours differ; ``first`` marks the first symbol of each text. Neighbours must differ."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[:1] = 0
    left[first] = ~symbols[first]  # a first symbol differs from its missing neighbour in the lowest bit
    differ = left ^ symbols
    low = np.bitwise_count((differ & (~differ + np.ones(1, differ.dtype))) - np.ones(1, differ.dtype))
    label = (low << 1) | ((symbols >> low.astype(symbols.dtype)).astype(np.uint8) & np.uint8(1))
    label = label.astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[:1] = 0
        before[first] = label[first] ^ np.uint8(1)
        label = _TABLE[(before.astype(np.uint16) << np.uint16(7)) | label]
    return label


def parse(symbols: np.ndarray, starts: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """One round: names of the phrases of all texts, one after the other, and the start of each text among them. ``starts`` are
    the places of the first symbols of the texts, none of which is empty."""
    with np.errstate(over="ignore"):
        first = np.zeros(len(symbols), bool)
        first[starts] = True
        fresh = np.empty(len(symbols), bool)
        fresh[0] = True
        np.not_equal(symbols[1:], symbols[:-1], out=fresh[1:])
        fresh |= first
        heads = np.flatnonzero(fresh)
        if len(heads) < len(symbols):
            runs = np.diff(heads, append=len(symbols))
            symbols = symbols[heads]
            many = np.flatnonzero(runs > 1)
            if symbols.dtype == np.uint32:
                # the name of a run is the same number in both widths, so it does not depend on the other texts
                if runs[many].max() >= 1 << 10:
                    symbols = symbols.astype(np.uint64)
                symbols[many] |= runs[many].astype(symbols.dtype) << symbols.dtype.type(21)  # above all code points
            else:
                symbols[many] = mix(symbols[many] + runs[many].astype(np.uint64) * _ODD)
            first = first[heads]
        label = toss(symbols, first)
        top = np.zeros(len(symbols), bool)
        top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        # the ends of texts are no maxima, the second symbol of a text starts no phrase of its own
        edge = np.flatnonzero(first)
        top[edge[1:] - 1] = False
        top[edge] = True
        begin = np.flatnonzero(top)
        length = np.diff(begin, append=len(symbols))
        place = np.arange(len(symbols)) - np.repeat(begin, length)
        if len(place) and place.max() >= len(_POWERS):
            place %= len(_POWERS)
        value = mix(symbols.astype(np.uint64) + np.uint64(level + 1) * _STEPS[1]) * _POWERS[place]
        names = mix(np.add.reduceat(value, begin) + length.astype(np.uint64) * _STEPS[0])
        return names, np.searchsorted(begin, edge)


def sketches(texts: Sequence[str], levels: int = LEVELS, k: int = KEEP) -> list[np.ndarray]:
    """The ``k`` smallest 32-bit hashes of the names of each text, sorted; empty for an empty text."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    held: list[int] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        symbols = np.frombuffer("".join(texts[i] for i in held).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        starts = np.concatenate(([0], np.cumsum([len(texts[i]) for i in held])[:-1]))
        for level in range(levels):
            symbols, starts = parse(symbols, starts, level)
        hashes = (mix(symbols) >> np.uint64(32)).astype(np.uint32)
        for i, s, e in zip(held, starts, np.append(starts[1:], len(hashes)), strict=True):
            out[i] = np.unique(hashes[s:e])[:k]
        held.clear()

    for i, t in enumerate(texts):
        if t:
            held.append(i)
            size += len(t)
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return out


def likeness(a: np.ndarray, b: np.ndarray, k: int = KEEP) -> float:
    """Shared part of two sets, by the ``k`` smallest members of their union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(both, union[-1], side="right")) / len(union)


def packed(sketch: np.ndarray) -> bytes:
    return sketch.astype(">u4").tobytes()


def edited(text: str, following: str) -> str:
    """The last quarter of the text (rounded down) replaced by the first as many code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_DONE, _LAST, _HEAD = 0, 1, 2


def compare_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text (see :func:`edited`), and the likeness of its own to the edited one's and
    to the next row's, in the order of the keys and after the last the first.

    Rows are range-partitioned and sorted, so the next row is met in the same pass. Only the first and the last row of each
    partition wait for a neighbour in another one: they are matched in a second step, two rows per partition."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")
    schema = f"part int, kind int, k {kind}, t string, n_chars bigint, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def frame(part: int, kinds: list, keys: pa.Array, texts: list, results: list) -> pa.RecordBatch:
        columns = list(zip(*results, strict=True)) if results else [()] * 6
        types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        arrays = [pa.array([part] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), keys, pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    def results(texts: list[str], following: list[str]) -> list[tuple]:
        changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
        n = len(texts)
        # following texts are the texts shifted by one, but for the last
        same = all(f is t for f, t in zip(following, texts[1:], strict=False))
        made = sketches([*texts, *changed, *(following[-1:] if same else following)])
        own, other = made[:n], made[n : 2 * n]
        after = [*own[1:], made[2 * n]] if same else made[2 * n :]
        return [
            (len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest(), packed(a), packed(b), likeness(a, b), likeness(a, x))
            for t, c, a, b, x in zip(texts, changed, own, other, after, strict=True)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        waiting: tuple[pa.Array, str] | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                keys, texts = piece.column("k"), text_of(piece, "t")
                if waiting is None:
                    yield frame(part, [_HEAD], keys.slice(0, 1), texts[:1], [(None,) * 6])
                else:
                    keys, texts = pa.concat_arrays([waiting[0], keys]), [waiting[1], *texts]
                waiting = (keys.slice(len(texts) - 1, 1), texts[-1])
                if len(texts) > 1:
                    yield frame(part, [_DONE] * (len(texts) - 1), keys.slice(0, len(texts) - 1), [None] * (len(texts) - 1), results(texts[:-1], texts[1:]))
        if waiting is not None:
            yield frame(part, [_LAST], waiting[0], [waiting[1]], [(None,) * 6])

    made = keep(ordered.mapInArrow(run, schema), "fingerprints")
    heads = made.filter(F.col("kind") == _HEAD)
    # one small row per partition
    every = Window.partitionBy(F.lit(0)).orderBy("part")
    follows = heads.select("part", F.lead("part").over(every).alias("n"), F.min("part").over(Window.partitionBy(F.lit(0))).alias("f")).select("part", F.coalesce("n", "f").alias("next"))
    last = made.filter(F.col("kind") == _LAST).select("part", "k", "t").join(follows, "part")
    joined = last.join(heads.select(F.col("part").alias("next"), F.col("t").alias("following")), "next").select("part", "k", "t", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n = batch.num_rows
                pairs = zip(text_of(batch, "t"), text_of(batch, "following"), strict=True)
                yield frame(0, [_DONE] * n, batch.column("k"), [None] * n, [results([t], [f])[0] for t, f in pairs])

    whole = made.filter(F.col("kind") == _DONE).union(joined.mapInArrow(finish, schema))
    text_form = [F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    return whole.select(F.col("k").alias(key), "n_chars", *text_form, "near_edited", "near_next")
