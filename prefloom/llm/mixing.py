"""Mixing sources to target weights by Pfair scheduling; DataFrame and SQL functions only.

Each source's documents are put into an order by the hash of their key and cut into blocks. Weights are whole numbers: given ones are read as
decimals of 18 places and divided by their greatest common divisor, so nothing is rounded to a period. Of a source with weight w of a total W, the i-th
block (i from 0) is released at slot floor(i * W / w) and due before slot ceil((i + 1) * W / w); each slot goes to the released block that is due first,
ties to the smaller weight, then to the source's name, nulls last. The windows of all blocks can be met together, so each source's count stays within one block of its target
at every slot until it runs out. Slots for which no block is left stay empty.

Earliest deadline first is worked out in segments of time. A segment first runs for itself: of the blocks released in it some find a slot, the
others are left over. Blocks that come in from earlier segments may use any of its slots, so they displace exactly those that are due
last: incoming and placed blocks together are sorted by due time, the first ones that there are slots for stay and the others go on with the left-over ones. At most
one block a source goes on, so a segment's outcome is told by its left-over blocks, as many of its placed ones as there are sources (those due last) and the
number of its free slots. These small rows are folded along time, and each segment then runs once more with what comes in. The work is that of the
blocks there are, not of the slots: a weight of a thousand-millionth costs nothing more. Segments hold about ``SEGMENT`` blocks, one a source at least.

Ranks inside a source come from counts of hash ranges, so a source with a third of all rows is ranked by many tasks.

Cases: a null source is a source of its own; rows with a null key are ordered by the hash of all they hold, repeated rows are placed each for itself; sources without a
weight (none given, null, not above 0 or not a number) have null slots and come after all others, in the order of their ranks; several weights
of one source add up; a weight that 18 places or a total of 10^18 (after the division) can't hold is an error. Without weights they follow the
square root of their size, in thousandths. An empty table gives an empty result. All columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.functions.common import let
from prefloom.llm.common import spare
from prefloom.session import keep

BLOCK = 16
#: blocks of a segment
SEGMENT = 2000
#: rows of a source that are ranked in one task
RANKED_TOGETHER = 2000
#: blocks of a source that are made from one row
MADE_TOGETHER = 4096
ADDED = ("source_rank", "block", "slot", "release", "due")

_WHOLE = "decimal(38,0)"


def _given(weights: DataFrame, source: str) -> DataFrame:
    """``source, w``: weights above 0 in units of 10^-18."""
    weight = F.col("weight").cast("double")
    sound = (weight > 0) & (weight < float("inf"))
    exact = F.expr("try_cast(weight AS decimal(38,18))")
    held = F.when(exact > 0, exact).otherwise(F.raise_error(F.lit("a weight needs more than 18 decimal places or 20 digits before them")).cast("decimal(38,18)"))
    rows = weights.filter(sound).select(F.col(f"`{source}`").alias("source"), held.alias("x")).withColumn("whole", F.floor("x").cast("decimal(20,0)"))
    unit = F.lit(10**18).cast("decimal(19,0)")
    parts = (F.col("whole") * unit).cast(_WHOLE) + ((F.col("x") - F.col("whole")).cast("decimal(18,18)") * unit).cast(_WHOLE)
    return rows.groupBy("source").agg(F.sum(parts.cast(_WHOLE)).cast(_WHOLE).alias("w"))


def _divisor(numbers: Column) -> Column:
    """Greatest common divisor of an array of whole decimals; numbers of 38 digits need at most 182 steps each."""
    zero = F.lit(0).cast(_WHOLE)

    def two(a: Column, b: Column) -> Column:
        start = F.struct(a.alias("a"), b.alias("b"))
        following = lambda s: F.struct(s["b"].alias("a"), (s["a"] % s["b"]).cast(_WHOLE).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(190)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(following(s)), lambda s: s["a"])

    return F.aggregate(numbers, zero, two)


def shares(df: DataFrame, source: str = "source", weights: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``k, source, w, total, blocks``: one row per source that has rows and a weight, numbered by weight and name; w of total is its target."""
    sizes = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("w", F.floor(F.sqrt(F.col("n").cast("double")) * 1000).cast(_WHOLE))
    else:
        given = _given(weights, source).withColumnRenamed("source", "of")
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    item = F.struct("w", F.col("source").isNull().alias("none"), "source", "n")
    # one row per source: a list of them is no bottleneck
    one = weighed.agg(F.sort_array(F.collect_list(item)).alias("list")).filter(F.size("list") > 0)
    one = one.withColumn("g", _divisor(F.transform("list", lambda s: s["w"])))
    total = F.aggregate("list", F.lit(0).cast(_WHOLE), lambda a, s: (a + s["w"]).cast(_WHOLE))
    one = one.withColumn("total", (total / F.col("g")).cast(_WHOLE))
    fits = F.assert_true(F.col("total") <= F.lit(10**18), F.lit("the weights have no common unit within 10^18"))
    each = one.filter(fits.isNull()).select("g", "total", F.posexplode("list").alias("k", "s"))
    return each.select(
        "k",
        F.col("s.source").alias("source"),
        (F.col("s.w") / F.col("g")).cast("decimal(19,0)").alias("w"),
        F.col("total").cast("decimal(19,0)").alias("total"),
        F.expr(f"(s.n + {block - 1}) div {block}").alias("blocks"),
    )


def _run(groups: Column, incoming: Column, end: Column) -> Column:
    """Earliest deadline first over one segment: ``left, placed``. ``groups`` are its blocks by release, in order; what comes in is ready at the first of
    them; ``end`` is the first slot behind the segment, null for none."""
    block = "struct<due:bigint,k:int,block:bigint,release:bigint>"
    timed = F.transform(groups, lambda g, j: F.struct(g["release"].alias("at"), F.coalesce(F.get(groups, j + 1)["release"], end).alias("until"), g["blocks"].alias("blocks")))

    def step(s: Column, g: Column) -> Column:
        def settle(ready: Column) -> Column:
            n = F.least(F.size(ready), F.coalesce(g["until"] - g["at"], F.lit(1 << 62))).cast("int")
            now = F.transform(F.slice(ready, F.lit(1), n), lambda b, j: F.struct(b.alias("b"), (g["at"] + j).alias("slot")))
            return F.struct(F.slice(ready, n + 1, F.size(ready)).alias("left"), F.concat(s["placed"], now).alias("placed"))

        return let(F.sort_array(F.concat(s["left"], g["blocks"])), settle)

    start = F.struct(incoming.alias("left"), F.array().cast(f"array<struct<b:{block},slot:bigint>>").alias("placed"))
    return F.aggregate(timed, start, step)


def schedule(shared: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``k, block, slot, release, due`` of all blocks of the stored :func:`shares`: earliest deadline first."""
    n, blocks = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    block = "struct<due:bigint,k:int,block:bigint,release:bigint>"
    none = F.array().cast(f"array<{block}>")
    # a source of very many blocks is made by many tasks
    begun = shared.select("k", "w", "total", "blocks", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1, F.lit(MADE_TOGETHER).cast("bigint"))).alias("first"))
    made = begun.repartition("k", "first").withColumn("block", F.explode(F.expr(f"sequence(first, least(first + {MADE_TOGETHER - 1}, blocks - 1))")))
    made = made.select("k", "block", F.expr("(block * total) div w").alias("release"), F.expr("((block + 1) * total + w - 1) div w").alias("due"))
    # blocks with one release are in one segment
    cut = made.repartitionByRange(max(1, -(-blocks // max(segment, n))), "release").withColumn("part", F.spark_partition_id())
    cut = keep(cut, "blocks")
    begins = cut.groupBy("part").agg(F.min("release").alias("begin"))
    begins = begins.withColumn("end", F.lead("begin").over(Window.partitionBy(F.lit(0)).orderBy("begin")))
    same = cut.groupBy("part", "release").agg(F.collect_list(F.struct("due", "k", "block", "release")).alias("blocks"))
    groups = same.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("release", "blocks"))).alias("groups"))
    groups = keep(groups.join(begins, "part"), "segments")

    alone = groups.select("begin", "end", _run(F.col("groups"), none, F.col("end")).alias("r"))
    placed = F.sort_array(F.transform("r.placed", lambda p: p["b"]))
    last = let(placed, lambda p: F.slice(p, F.greatest(F.size(p) - n, F.lit(0)) + 1, F.lit(max(n, 1))))
    told = alone.select("begin", last.alias("last"), (F.coalesce("end", F.lit(1 << 62)) - F.col("begin") - F.size("r.placed")).alias("free"), F.col("r.left").alias("left"))

    def forward(s: Column, t: Column) -> Column:
        room = F.size(t["last"]) + t["free"]
        beyond = let(F.sort_array(F.concat(s["coming"], t["last"])), lambda b: F.slice(b, F.least(room, F.size(b)).cast("int") + 1, F.size(b)))
        came = F.struct(t["begin"].alias("begin"), s["coming"].alias("coming"))
        return F.struct(F.concat(beyond, t["left"]).alias("coming"), F.concat(s["out"], F.array(came)).alias("out"))

    start = F.struct(none.alias("coming"), F.array().cast(f"array<struct<begin:bigint,coming:array<{block}>>>").alias("out"))
    told = told.agg(F.sort_array(F.collect_list(F.struct("begin", "last", "free", "left"))).alias("told"))
    came = told.select(F.explode(F.aggregate("told", start, forward, lambda s: s["out"])).alias("c")).select("c.begin", "c.coming")
    done = groups.join(came, "begin").select(F.explode(_run(F.col("groups"), F.col("coming"), F.col("end"))["placed"]).alias("p"))
    return done.select("p.b.k", "p.b.block", "p.slot", "p.b.release", "p.b.due")


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and _has_map(kind.elementType))


def source_ranks(df: DataFrame, count: int) -> DataFrame:
    """``df`` (columns row, key, source; ``count`` rows) with ``source_rank`` (from 0): the place of a row in its source, by the hash of its key. Rows
    are ranked inside ranges of the hash, whose number grows with the rows, and the counts of the ranges are summed up."""
    fields = df.schema["row"].dataType.fields
    # rows of one key are told apart by all they hold, so that a repeated task ranks them alike; maps can't be hashed but written
    tie = F.xxhash64(*[F.to_json(F.struct(F.col("row")[f.name])) if _has_map(f.dataType) else F.col("row")[f.name] for f in fields])
    h = F.md5(F.coalesce(F.col("key").cast("string"), tie.cast("string")).cast("binary"))
    digits = 1
    while 16**digits * RANKED_TOGETHER < count:
        digits += 1
    cut = df.withColumn("h", h).withColumn("range", F.substring("h", 1, digits)).withColumn("of", F.struct("source"))
    sums = cut.groupBy("of", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("of", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("of", "range").orderBy("h", "key", tie)
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(sums, ["of", "range"])
    return ranked.select("row", "source", (F.col("before") + F.col("rank")).alias("source_rank"))


def _placed(df: DataFrame, key: str, source: str, weights: DataFrame | None, block: int, segment: int) -> DataFrame:
    """``row`` (all columns of ``df``) with ``ADDED``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"))
    shared = keep(shares(df, source, weights, block), "shares")
    slots = keep(schedule(shared, segment), "slots").withColumnRenamed("block", "turn")
    ranked = source_ranks(rows, df.count()).withColumn("block", F.expr(f"source_rank div {block}"))
    numbered = ranked.join(shared.select(F.col("source").alias("s"), F.col("k").alias("of")), F.col("source").eqNullSafe(F.col("s")), "left")
    placed = numbered.join(slots, (F.col("of") == F.col("k")) & (F.col("block") == F.col("turn")), "left")
    return placed.select("row", *ADDED)


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """All rows and columns with ``source_rank, block, slot, release, due``; the mixture is the order by slot, source_rank.
    The last three are null for rows of a source without weight. An added column whose name is taken gets an underscore in front."""
    placed = _placed(df, key, source, weights, block, segment)
    return placed.select("row.*", *[F.col(c).alias(spare(df, c)) for c in ADDED])


def mixed_order(df: DataFrame, key: str = "doc_id", source: str = "source", weights: DataFrame | None = None, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """The rows of ``df`` in the order of the mixture: range partitions by slot, sorted inside."""
    placed = _placed(df, key, source, weights, block, segment)
    order = [F.coalesce("slot", F.lit(1 << 62)), F.col("source_rank")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def twin(block: int = BLOCK) -> str:
    """SQL for :func:`mix` over documents(doc_id, source) with weights by the square root of the sizes: one slot is given per step."""
    return f"""
WITH RECURSIVE weighed AS (
  SELECT source, (count(*) + {block - 1}) // {block} AS b, CAST(floor(sqrt(CAST(count(*) AS DOUBLE)) * 1000) AS BIGINT) AS w FROM documents GROUP BY source
), numbered AS (
  SELECT source, b, w, CAST(sum(w) OVER () AS BIGINT) AS total, row_number() OVER (ORDER BY w, source IS NULL, source) - 1 AS k FROM weighed
), run AS (
  SELECT CAST(-1 AS BIGINT) AS t, k, b, w, total, CAST(0 AS BIGINT) AS c, FALSE AS chosen FROM numbered
  UNION ALL
  SELECT now, k, b, w, total, c + CASE WHEN rn = 1 THEN 1 ELSE 0 END, rn = 1 FROM (
    SELECT *, row_number() OVER (ORDER BY CASE WHEN c < b AND c * total // w <= now THEN 0 ELSE 1 END, ((c + 1) * total + w - 1) // w, k) AS rn
    FROM (
      SELECT *, greatest(t + 1, soonest) AS now FROM (
        SELECT *, min(CASE WHEN c < b THEN c * total // w END) OVER () AS soonest FROM run
      ) WHERE soonest IS NOT NULL
    )
  )
), slots AS (
  SELECT source, c - 1 AS block, t AS slot, (c - 1) * run.total // run.w AS release, (c * run.total + run.w - 1) // run.w AS due
  FROM run JOIN numbered USING (k) WHERE chosen
), ranked AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS source_rank FROM documents
)
SELECT doc_id, ranked.source, source_rank, source_rank // {block} AS block, slot, release, due
FROM ranked JOIN slots ON ranked.source IS NOT DISTINCT FROM slots.source AND source_rank // {block} = block
"""
