"""Ranks and running totals that never put one whole group into one task.

A plain window over a hot key (or over no key) sorts that whole group in a single task. Here the rows are cut into parts by
their full order key: Spark samples it for the bounds of a range partitioning, so parts hold about ``ROWS_PER_PART`` rows however ids, hours or
keys are spread, and their number is that of the rows divided by it. Rows that carry texts or arrays make more parts, of about ``BYTES_PER_PART``. The part of each row is stored in the shared folder, so every later
step, a repeated task too, sees the same parts. Work per row happens inside (group, part); only one row per
(group, part) is combined across parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

from prefloom.functions.common import col
from prefloom.session import keep

ROWS_PER_PART = 500_000
BYTES_PER_PART = 64 << 20


def _width(df: DataFrame) -> Column:
    """Bytes of the texts of a row and of the elements of its arrays, each taken as 8."""
    kinds = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    sizes = [F.octet_length(c) for c, kind in kinds if isinstance(kind, StringType | BinaryType)]
    sizes += [F.size(c) * 8 for c, kind in kinds if isinstance(kind, ArrayType)]
    return sum((F.coalesce(s, F.lit(0)).cast("bigint") for s in sizes), F.lit(0).cast("bigint"))


def in_parts(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), rows: int | None = None) -> DataFrame:
    """``df`` with ``_part``: a number that does not fall along (by, order), about ``rows`` rows to each and at most about ``BYTES_PER_PART``."""
    count, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    n = max(-(-count // (rows or ROWS_PER_PART)), -(-size // BYTES_PER_PART))
    if n <= 1:
        return df.withColumn("_part", F.lit(0))
    cut = df.repartitionByRange(n, *[F.col(c) for c in by], *order)
    return keep(cut.withColumn("_part", F.spark_partition_id()), "parts")


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    value: Column,
    out: str,
    order: Sequence[Column | str],
    by: Sequence[str] = (),
    how: str = "sum",
    inclusive: bool = True,
    rows: int | None = None,
) -> DataFrame:
    """Running sum, max or min of ``value`` along ``order`` inside each ``by`` group.

    ``order`` must be total inside a group. With ``inclusive=False`` the current row is left out, and the first
    row of a group gets null (0 for sums). Keep a costly input in a table first: it is counted, cut and then read.
    """
    agg = _COMBINE[how]
    order = [col(c) for c in order]
    cut = in_parts(df.withColumn("_val", value), order, by, rows)
    # the key is one struct so that null group values join with themselves
    keyed = cut.withColumn("_key", F.struct(*[F.col(c) for c in by], F.col("_part")))
    totals = keyed.groupBy("_key").agg(agg("_val").alias("_total"))
    across = Window.partitionBy(*[F.col(f"_key.{c}") for c in by]).orderBy("_key._part")
    before = totals.select("_key", agg("_total").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    end = 0 if inclusive else -1
    inside = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    local = keyed.withColumn("_local", agg("_val").over(inside))
    joined = local.join(before, "_key")
    if how == "sum":
        result = F.coalesce("_before", F.lit(0)) + F.coalesce("_local", F.lit(0))
    elif how == "max":
        result = F.greatest("_before", "_local")
    else:
        result = F.least("_before", "_local")
    return joined.withColumn(out, result).drop("_key", "_val", "_local", "_before", "_part")


def positions(
    df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "idx", rows: int | None = None
) -> DataFrame:
    """Zero-based position of each row inside its ``by`` group (or the whole table) along ``order``."""
    ranked = running(df, F.lit(1).cast("bigint"), out, order, by, rows=rows)
    return ranked.withColumn(out, F.col(out) - 1)


def collect_sequences(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """One row per sequence, whole: ``key, items array<struct>`` in the order of ``order``. A sequence is what a model reads or writes
    at once, so like any array column it must fit a task."""
    item = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *fields])])
    return df.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("items"))
