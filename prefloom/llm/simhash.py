"""SimHash fingerprints, links between those that differ in few bits, and the groups that the links make.

Fingerprints: bit b is 1 when it is set in over half the XXH64 values (seed 42) of the text's word shingles, repeats
included.

Links: two 64-bit values that differ in at most ``radius`` bits agree in at least ``parts - radius`` of ``parts`` fixed parts of the
64 bits, so each pair of near values meets in a bucket keyed by some ``parts - radius`` of them; no pair is lost. More
parts give more and narrower buckets; ``parts`` is chosen so that an even spread gives small buckets. A bucket of any size is
compared in tiles of 64 rows by 64 columns; a large one is cut into row blocks that meet pairwise in tasks of their own.

Wide fingerprints (:func:`near_groups`) are for similarities that a 64-bit radius of a few bits can't reach, such as a shared part of 0.8
of all shingles: many bands of a dozen bits each make the buckets, and a value of several words is compared. Their hashes are those of the
distinct shingles. Bands are so many that a pair at the wanted similarity misses all of them once in a thousand times; the radius lies four deviations
above the pair's expected distance. A pair within it is a candidate only: it is a link if the shingles of both texts share the wanted part. Pairs are
never rows. Buckets give spanning links between candidates, which join them to candidate groups. First those links are held against the texts
(:func:`verified`), so a group of n copies takes about n comparisons. Where that leaves a group in several parts, its ids go into blocks, and each pair of
blocks that are not both of one and the same part is a task (:func:`rest_verified`): it finds the near pairs again from the wide values, passes over those whose ends
are linked by then, compares the others and gives spanning links of what it verified. A text is sent once to each pair of blocks that needs it.

Comparison is bit-sliced: a tile keeps the 64 columns as bit planes, one word each. For a row, the plane (or its
complement) is the word of columns that differ in that bit; carry-save counters add the words up for all 64 columns at
once, and rows whose columns have all passed the radius are abandoned. Tiles in which everything is linked already are
passed over where links are wanted as components only: every task then gives a spanning set of the links it finds.

Cases: a null text counts as empty; texts without words have fingerprint zero and are linked as any other (in :func:`near_groups`
with each other only); equal fingerprints are one group there, equal sets of shingles in :func:`near_groups`; a null key has a row as any other, and a group's id is the smallest key that is not null.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import components, local_roots, map_batches, spare, text_of
from prefloom.llm.fingerprint import mix
from prefloom.session import keep

SHINGLE = 4
SEED = 42
RADIUS = 4
#: rows of one bucket that one task compares with each other or with as many others
BLOCK = 4_096
#: texts of one group of candidates whose shingles one task holds, and as many others
TEXTS = 256
#: an even spread should leave about this many values in a bucket at most
BUCKET = 2_048


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all word shingles of a text, of its whole word sequence where it has fewer words, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits that are set in over half of ``hashes`` (values x words)."""
    n, words = hashes.shape
    bits = np.zeros(64 * words, np.int64)
    for k in range(0, n, 255):  # sums of 255 bits fit a byte
        some = np.ascontiguousarray(hashes[k : k + 255]).view(np.uint8).reshape(-1, 8 * words)
        bits += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(bits * 2 > n, bitorder="little").view("<u8").astype(np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of a text."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def distinct_shingles(text: str, shingle: int) -> np.ndarray:
    """The sorted hashes of the distinct word shingles of a text."""
    return np.unique(shingle_hashes(text, shingle))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def wide_fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of ``words`` words of distinct shingle hashes: further hashes of a shingle are mixed from its first one."""
    with np.errstate(over="ignore"):
        return majority(mix(h[:, None] + np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp``: fp is the fingerprint as a signed long."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(t, shingle) for t in text_of(batch, text)], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(made.view(np.int64))], names=[key, "fp"])

    return map_batches(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, fp bigint")


def _spans(parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the parts."""
    width, wider = divmod(64, parts)
    out, at = [], 0
    for k in range(parts):
        w = width + (k < wider)
        out.append((at, w))
        at += w
    return out


def parts_for(n: int, radius: int = RADIUS) -> int:
    """The least number of parts for which ``n`` evenly spread values leave ``BUCKET`` at most in a bucket. It sets the time only: any number of
    parts finds all near pairs."""
    for parts in range(radius + 1, 2 * radius + 4):
        if n / 2 ** (64 * (parts - radius) / parts) <= BUCKET:
            return parts
    return 2 * radius + 4


def band_keys(fp: Column, parts: int, radius: int = RADIUS) -> Column:
    """array<struct<band, bits>>: the value's bits in every choice of ``parts - radius`` parts."""
    spans = _spans(parts)
    out = []
    for band, chosen in enumerate(combinations(range(parts), parts - radius)):
        mask = sum(((1 << spans[k][1]) - 1) << spans[k][0] for k in chosen)
        mask -= (1 << 64) * (mask >> 63)
        out.append(F.struct(F.lit(band).alias("band"), fp.bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")))
    return F.array(*out)


def compare_tiles(fps: np.ndarray, columns: np.ndarray, rows: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (column, row) of tiles: ``fps`` is values x words, ``columns`` and ``rows`` are arrays tiles x 64 of places in it,
    -1 where a tile has none."""
    tiles, width = len(columns), fps.shape[1]
    values = np.where(columns[:, :, None] >= 0, fps[columns], 0).astype(np.uint64)
    # bit planes: planes[t, b] has bit c set when column c of tile t has bit b set
    bits = np.unpackbits(values.view(np.uint8).reshape(tiles, 64, 8 * width), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little").copy().view("<u8").reshape(tiles, 64 * width)
    valid = np.packbits(columns >= 0, axis=1, bitorder="little").copy().view("<u8").reshape(tiles)
    tile = np.repeat(np.arange(tiles), 64)
    place = rows.reshape(-1)
    live = np.flatnonzero(place >= 0)
    tile, place = tile[live], place[live]
    word = fps[place]
    # the counters: a number below 2**levels per column, and a mark for those that have passed the radius
    levels = max(3, int(radius + 1).bit_length() + 1)
    count = [np.zeros(len(word), np.uint64) for _ in range(levels)]
    passed = ~valid[tile]
    one, zero = np.uint64(1), np.uint64(0)

    def above() -> np.ndarray:
        """Columns whose counter exceeds the radius, by comparing from the highest bit on."""
        more, same = np.zeros_like(passed), np.full_like(passed, ~zero)
        for k in reversed(range(levels)):
            if radius >> k & 1:
                same = same & count[k]
            else:
                more |= same & count[k]
                same = same & ~count[k]
        return more

    for b in range(0, 64 * width, 2):
        own, at = word[:, b // 64], np.uint64(b % 64)
        x = planes[tile, b] ^ (zero - (own >> at & one))
        y = planes[tile, b + 1] ^ (zero - (own >> (at + one) & one))
        # carry-save: three words into a sum and a carry, which ripples up
        half = x ^ y
        carry = (x & y) | (half & count[0])
        count[0] ^= half
        for k in range(1, levels):
            carry, count[k] = carry & count[k], count[k] ^ carry
        passed |= carry
        if b >= radius and b % 8 == 6:
            passed |= above()
            rest = passed != ~zero
            if not rest.all():
                tile, place, word, passed = tile[rest], place[rest], word[rest], passed[rest]
                count = [c[rest] for c in count]
                if not len(tile):
                    break
    near = ~passed
    hits = np.flatnonzero(near)
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lanes = np.unpackbits(near[hits].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    hit, lane = np.nonzero(lanes)
    a, b = columns[tile[hits[hit]], lane], place[hits[hit]]
    return a, b


def spanning_links(groups: list[np.ndarray], other: list[np.ndarray | None], radius: int = RADIUS, tiles_at_once: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all near pairs within each group (or between it and ``other``), as places in the
    groups joined one after the other; a group is values x words."""
    fps = np.concatenate([np.concatenate([g, o]) if o is not None else g for g, o in zip(groups, other, strict=True)])
    cols, rws = [], []
    base = 0
    label = np.arange(len(fps))

    def flush() -> None:
        nonlocal label, cols, rws
        if not cols:
            return
        c, r = np.concatenate(cols), np.concatenate(rws)
        cols, rws = [], []
        for k in range(0, len(c), tiles_at_once):
            cc, rr = c[k : k + tiles_at_once], r[k : k + tiles_at_once]
            # a tile all of which is linked already tells nothing new
            lc, lr = np.where(cc >= 0, label[cc], -1), np.where(rr >= 0, label[rr], -1)
            first = lc[:, :1]
            known = (((lc == first) | (lc < 0)) & ((lr == first) | (lr < 0))).all(1)
            cc, rr = cc[~known], rr[~known]
            if len(cc):
                a, b = compare_tiles(fps, cc, rr, radius)
                label = local_roots(a, b, len(fps), label)

    held = 0
    for g, o in zip(groups, other, strict=True):
        n, m = len(g), len(o) if o is not None else 0
        size = n + m
        one = np.arange(base, base + n)
        two = np.arange(base + n, base + size) if o is not None else one
        left = np.full((-(-n // 64), 64), -1)
        left.reshape(-1)[:n] = one
        right = np.full((-(-len(two) // 64), 64), -1)
        right.reshape(-1)[: len(two)] = two
        for i in range(len(left)):
            js = np.arange(0 if o is not None else i, len(right))
            cols.append(np.broadcast_to(left[i], (len(js), 64)))
            rws.append(right[js])
            held += len(js)
            if held >= tiles_at_once:
                flush()
                held = 0
        base += size
    flush()
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return linked, label[linked]


def near_pairs(groups: list[np.ndarray], other: list[np.ndarray | None], radius: int, tiles_at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All near pairs within each group (or between it and ``other``), each once, as places in the groups joined one after the other."""
    fps = np.concatenate([np.concatenate([g, o]) if o is not None else g for g, o in zip(groups, other, strict=True)])
    cols, rws, held, base = [], [], 0, 0

    def flush() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        c, r = np.concatenate(cols), np.concatenate(rws)
        cols.clear()
        rws.clear()
        for k in range(0, len(c), tiles_at_once):
            a, b = compare_tiles(fps, c[k : k + tiles_at_once], r[k : k + tiles_at_once], radius)
            once = a < b  # a tile with itself gives each pair twice; in all others columns stand before rows
            yield a[once], b[once]

    for g, o in zip(groups, other, strict=True):
        n, m = len(g), len(o) if o is not None else 0
        one = np.arange(base, base + n)
        two = np.arange(base + n, base + n + m) if o is not None else one
        base += n + m
        left, right = (np.full((-(-len(x) // 64), 64), -1) for x in (one, two))
        left.reshape(-1)[:n] = one
        right.reshape(-1)[: len(two)] = two
        for i in range(len(left)):
            js = np.arange(0 if o is not None else i, len(right))
            cols.append(np.broadcast_to(left[i], (len(js), 64)))
            rws.append(right[js])
            held += len(js)
            if held >= tiles_at_once:
                yield from flush()
                held = 0
    if cols:
        yield from flush()


def links(values: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """``a, b``: pairs of the distinct values ``fp`` that are near, enough of them to span all components."""
    if parts is None:
        parts = parts_for(values.count(), radius)
    keyed = values.select(F.col("fp").alias("id"), F.col("fp").alias("w0"), F.explode(band_keys(F.col("fp"), parts, radius)).alias("k"))
    return compare_buckets(keyed.select("id", "k.band", "k.bits", "w0"), 1, radius)


def compare_buckets(keyed: DataFrame, width: int, radius: int) -> DataFrame:
    """``a, b``: ids of near values that meet in a bucket, enough of them to span all components. ``keyed`` has ``id`` (one
    for each distinct value), ``band``, ``bits`` and the words ``w0``, ``w1``, ... of the value."""
    sizes = keyed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.expr(f"cast((n + {BLOCK} - 1) div {BLOCK} as int)")
    words = [f"w{k}" for k in range(width)]
    # a value of block s meets all others in the tasks (min, max) of s and each block
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = (
        keyed.join(sizes, ["band", "bits"])
        .select("id", *words, "band", "bits", blocks.alias("blocks"))
        .withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", *words, "band", "bits", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own")
    )
    # by id, so that the links of several buckets tend to lead to the same least id
    placed = met.repartition("band", "bits", "i", "j").sortWithinPartitions("band", "bits", "i", "j", "own", "id")
    fields = ["band", "bits", "i", "j", "own", "id", *words]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: np.ndarray | None = None

        def work(rows: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray]:
            """The last group may go on in the next batch."""
            edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            starts = np.concatenate(([0], edge))
            ends = np.concatenate((edge, [len(rows)]))
            stay = rows[:0] if last else rows[starts[-1] :]
            if not last:
                starts, ends = starts[:-1], ends[:-1]
            groups, other, ids = [], [], []
            for s, e in zip(starts, ends, strict=True):
                values = np.ascontiguousarray(rows[s:e, 6:]).view(np.uint64)
                ids.append(rows[s:e, 5])
                if rows[s, 2] == rows[s, 3]:
                    groups.append(values)
                    other.append(None)
                else:
                    cut = int(np.searchsorted(rows[s:e, 4], rows[s, 3]))
                    groups.append(values[:cut])
                    other.append(values[cut:])
            if not groups:
                return None, stay
            every = np.concatenate(ids)
            a, b = spanning_links(groups, other, radius)
            return pa.RecordBatch.from_arrays([pa.array(every[a]), pa.array(every[b])], names=["a", "b"]) if len(a) else None, stay

        for batch in batches:
            if batch.num_rows:
                rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields], axis=1)
                out, rest = work(rows if rest is None else np.concatenate([rest, rows]), False)
                if out is not None:
                    yield out
        if rest is not None and len(rest):
            out, _ = work(rest, True)
            if out is not None:
                yield out

    return placed.mapInArrow(run, "a bigint, b bigint")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``key, fp, component_id``, the smallest key of all that links reach."""
    made = keep(fingerprints(df, key, text, shingle), "fingerprints")
    values = made.groupBy("fp").agg(F.min(key).alias("_least"))
    roots = components(keep(links(values.select("fp"), radius), "links"))
    placed = values.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = placed.groupBy("root").agg(F.min("_least").alias("component_id"))
    by_value = placed.join(ids, "root").select("fp", "component_id")
    return made.join(by_value, "fp").select(key, "fp", "component_id")


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    found = groups(df, key, text)
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@dataclass(frozen=True)
class Near:
    """Near duplicates by word shingles: words per shingle, the shared part of all shingles that is looked for, words of the value that is
    compared, bits per band, and how often a pair at just that similarity may miss all bands."""

    shingle: int = 5
    similarity: float = 0.8
    words: int = 8
    band_bits: int = 12
    missed: float = 0.001

    @property
    def differs(self) -> float:
        """Chance that one bit of two such texts differs: the angle between their shingle vectors."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.missed) / math.log(1 - (1 - self.differs) ** self.band_bits))

    @property
    def radius(self) -> int:
        n, p = 64 * self.words, self.differs
        return round(n * p + 4 * math.sqrt(n * p * (1 - p)))


def verified(pairs: DataFrame, roots: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts share the wanted part of their distinct shingles. ``roots`` has ``id, root``, the
    groups that the pairs join, and ``texts`` has ``id, t``.

    A group is cut into blocks of about ``TEXTS``; a task compares the pairs of two blocks."""
    sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    placed = keep(roots.join(sizes, "root").select("id", "root", F.pmod(F.xxhash64("id"), F.expr(f"(n + {TEXTS} - 1) div {TEXTS}")).cast("int").alias("block")), "blocks")
    end = lambda name: placed.select(F.col("id").alias(name), "root", F.col("block").alias(f"_{name}"))
    task = [F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j")]
    asked = keep(pairs.join(end("a"), "a").join(end("b").drop("root"), "b").select("root", *task, "a", "b"), "asked")
    needs = asked.select("root", "i", "j", F.col("a").alias("id")).union(asked.select("root", "i", "j", F.col("b").alias("id"))).distinct()
    given = needs.join(texts, "id").select("root", "i", "j", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("bigint").alias("b"), "t")
    both = given.union(asked.select("root", "i", "j", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("t")))
    # texts stand before the pairs that ask for them
    sorted_ = both.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("root", "i", "j", "kind", "a", "b")]
            for at, (root, i, j, kind, a, b) in enumerate(zip(*columns, strict=True)):
                if (root, i, j) != now:
                    now, held = (root, i, j), {}
                if kind == 0:
                    held[a] = distinct_shingles(batch.column("t")[at].as_py() or "", near.shingle)
                elif jaccard(held[a], held[b]) >= near.similarity:
                    found.append((a, b))
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return sorted_.mapInArrow(run, "a bigint, b bigint")


def rest_verified(open_: DataFrame, values: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """``a, b``: parts that a pair of texts links, enough of them to span all that do. ``open_`` has ``id, root, v``: ids of candidate
    groups ``root`` whose parts ``v`` are not linked yet; ``values`` has the words of each id."""
    words = [f"w{k}" for k in range(near.words)]
    sizes = open_.groupBy("root", "v").agg(F.count(F.lit(1)).alias("n"))
    # a part of many texts has blocks of its own, the others of a group share some
    small = sizes.filter(f"n < {TEXTS}").groupBy("root").agg(F.sum("n").alias("together"))
    own = F.concat(F.col("v").cast("string"), F.lit(":"), F.pmod(F.xxhash64("id"), F.expr(f"(n + {TEXTS} - 1) div {TEXTS}")).cast("string"))
    shared = F.concat(F.lit(":"), F.pmod(F.xxhash64("v"), F.expr(f"(together + {TEXTS} - 1) div {TEXTS}")).cast("string"))
    big = F.col("n") >= TEXTS
    placed = open_.join(sizes, ["root", "v"]).join(small, "root", "left").select("id", "root", "v", F.when(big, F.col("v")).alias("only"), F.when(big, own).otherwise(shared).alias("block"))
    placed = keep(placed, "placed")
    blocks = placed.select("root", "block", "only").distinct()
    side = lambda name: blocks.select("root", F.col("block").alias(name), F.col("only").alias(f"_{name}"))
    tasks = side("i").join(side("j"), "root").filter("i <= j and not coalesce(_i = _j, false)").select("root", "i", "j")
    asks = tasks.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    rows = placed.join(asks, ["root", "block"]).select("root", "i", "j", "block", "id", "v").join(values.select("id", *words), "id").join(texts, "id")
    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        held: list[tuple] = []

        def work() -> Iterator[pa.RecordBatch]:
            _, i, j = now
            first = np.array([r[0] == i for r in held])
            value = np.array([r[2 : 2 + near.words] for r in held], dtype=np.int64).view(np.uint64)
            label = {r[1]: r[1] for r in held}  # parts within the task

            def find(v: int) -> int:
                while label[v] != v:
                    label[v] = label[label[v]]
                    v = label[v]
                return v

            sets: dict[int, np.ndarray] = {}

            def shingles(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = distinct_shingles(held[k][-1] or "", near.shingle)
                return sets[k]

            found = []
            for a, b in near_pairs([value[first]], [None if i == j else value[~first]], near.radius):
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    one, two = find(held[x][1]), find(held[y][1])
                    if one != two and jaccard(shingles(x), shingles(y)) >= near.similarity:
                        label[max(one, two)] = min(one, two)
                        found.append((held[x][1], held[y][1]))
            if found:
                x, y = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("root", "i", "j")]
            fields = [batch.column(c).to_pylist() for c in ("block", "v", *words, "t")]
            for key, row in zip(zip(*keys, strict=True), zip(*fields, strict=True), strict=True):
                if key != now:
                    if held:
                        yield from work()
                    now, held = key, []
                held.append(row)
        if held:
            yield from work()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_groups(df: DataFrame, key: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """One row per input row: ``row_id`` (a hash of key and text), ``key``, ``root`` (the same for all rows of a group)."""
    total = max(near.words, -(-near.bands * near.band_bits // 64))
    names = [f"w{k}" for k in range(near.words)]
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.xxhash64(key, text).alias("row_id"), F.col(key).alias("k"), F.col(text).alias("t"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_of(batch, "t")
        sets = [distinct_shingles(t, near.shingle) for t in texts]
        made = np.array([wide_fingerprint(h, total) for h in sets], dtype=np.uint64).reshape(len(texts), total)
        bits = np.unpackbits(made.view(np.uint8), axis=1, bitorder="little")[:, : near.bands * near.band_bits]
        keys = bits.reshape(len(texts), near.bands, near.band_bits).astype(np.int32) @ (1 << np.arange(near.band_bits, dtype=np.int32))
        ids = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], dtype=np.uint64)  # equal sets of shingles are one value
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * near.bands, pa.int32()), pa.array(keys.reshape(-1).astype(np.int32)))
        words = [pa.array(made[:, k].view(np.int64)) for k in range(near.words)]
        return pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("k"), pa.array(ids.view(np.int64)), lists, *words], names=["row_id", "k", "id", "bands", *names])

    made = keep(map_batches(rows, work, f"row_id bigint, k {kind}, id bigint, bands array<int>, {', '.join(f'{n} bigint' for n in names)}"), "fingerprints")
    values = made.select("id", "bands", *names).dropDuplicates(["id"])
    keyed = values.select("id", F.posexplode("bands").alias("band", "bits"), *names).withColumn("bits", F.col("bits").cast("bigint"))
    candidates = keep(compare_buckets(keyed, near.words, near.radius).distinct(), "candidates")
    groups_ = keep(components(candidates), "candidategroups")
    # one text for each value that is a candidate
    chosen = made.join(groups_.select("id"), "id").groupBy("id").agg(F.min("row_id").alias("row_id"))
    texts = keep(chosen.join(rows.select("row_id", "t"), "row_id").select("id", "t").dropDuplicates(["id"]), "texts")
    parts = components(keep(verified(candidates, groups_, texts, near), "links"))
    now = keep(groups_.join(parts.withColumnRenamed("root", "v"), "id", "left").withColumn("v", F.coalesce("v", "id")), "parts")
    several = now.groupBy("root").agg(F.min("v").alias("low"), F.max("v").alias("high")).filter("low < high")
    open_ = keep(now.join(several, "root", "left_semi"), "open")
    last = components(keep(rest_verified(open_, made.select("id", *names).dropDuplicates(["id"]), texts, near), "links"))
    roots = now.select("id", "v").join(last.select(F.col("id").alias("v"), F.col("root").alias("last")), "v", "left").select("id", F.coalesce("last", "v").alias("root"))
    found = made.select("row_id", "k", "id").join(roots, "id", "left")
    return found.select("row_id", F.col("k").alias(key), F.coalesce("root", "id").alias("root"))


def drop_near(df: DataFrame, key: str = "doc_id", text: str = "text", near: Near = Near()) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the row with the smallest key stays (null keys last, ties by a hash of the
    text, and of equal rows one)."""
    groups_ = near_groups(df, key, text, near)
    first = groups_.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("row_id"))).alias("m"))
    mark, turn = spare(df, "row_id"), spare(df, "turn")
    marked = df.withColumn(mark, F.xxhash64(key, text))
    kept = marked.join(first.select(F.col("m.row_id").alias(mark)), mark, "left_semi")
    one = Window.partitionBy(mark).orderBy(F.lit(1))
    return kept.withColumn(turn, F.row_number().over(one)).filter(F.col(turn) == 1).select(*df.columns)
