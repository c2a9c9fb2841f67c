"""Overlapping chunks of long sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_chunks(df: DataFrame, ids: Column, w: int, pad: int = 0) -> DataFrame:
    """Pad each sequence to a multiple of ``2w`` and cut it into chunks of ``2w`` with stride ``w``."""
    padded = df.withColumn("_n", F.size(ids)).withColumn(
        "_ids", F.concat(ids, F.array_repeat(F.lit(pad), (F.lit(2 * w) - F.col("_n") % (2 * w)) % (2 * w)))
    )
    last = F.floor(F.size("_ids") / w) - 2
    rows = padded.filter(F.size("_ids") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return rows.withColumn("chunk_ids", F.slice("_ids", (F.col("chunk") * w + 1).cast("int"), F.lit(2 * w))).drop("_n", "_ids")
