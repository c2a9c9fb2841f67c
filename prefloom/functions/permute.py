"""Seeded permutations of 0 .. n-1 without a sort: the new place of a row follows from its place.

A place x is a cell (l, r) of a table of a rows and b columns that holds n cells and less than one row more. Rounds shift l by a hash of r and r by a hash of l
in turn; each can be undone, so together they are a permutation of the cells. Where it leads behind n - 1, it is applied again until it does not, which
keeps it a permutation of the first n. Less than one place in sqrt(n) needs that. No row has to know any other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions.common import col, let

ROUNDS = 4


def _shift(seed: Column, number: int, value: Column) -> Column:
    text = F.concat_ws(":", seed.cast("string"), F.lit(str(number)), value.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def _round(l: Column, r: Column, a: Column, b: Column, seed: Column, number: int) -> tuple[Column, Column]:
    return ((l + _shift(seed, number, r)) % a, r) if number % 2 == 0 else (l, (r + _shift(seed, number, l)) % b)


def _once(x: Column, a: Column, b: Column, seed: Column) -> Column:
    """All rounds as one expression, each value being bound once."""
    cell = F.struct((x - x % b).cast("bigint").alias("lb"), (x % b).alias("r"))
    made = let(cell, lambda c: F.struct((c["lb"] / b).cast("bigint").alias("l"), c["r"].alias("r")))

    def turn(number: int):  # noqa: ANN202
        def of(c: Column) -> Column:
            l, r = _round(c["l"], c["r"], a, b, seed, number)
            return F.struct(l.alias("l"), r.alias("r"))

        return of

    for k in range(ROUNDS):
        made = let(made, turn(k))
    return let(made, lambda c: c["l"] * b + c["r"])


def permuted(df: DataFrame, place: Column | str, n: Column | int, seed: Column | int, out: str) -> DataFrame:
    """``df`` with ``out``: where the row at ``place`` (0 .. n-1) stands in the permutation that ``seed`` draws. Columns as ``n`` and ``seed`` give each
    group its own permutation. A null place gives null."""
    names = ["_x", "_n", "_seed", "_a", "_b", "_l", "_r"]
    count = F.lit(n) if isinstance(n, int) else n
    key = F.lit(seed) if isinstance(seed, int) else seed
    rows = df.withColumns({"_x": col(place).cast("bigint"), "_n": count.cast("bigint"), "_seed": key.cast("string")})
    rows = rows.withColumn("_a", F.greatest(F.ceil(F.sqrt(F.col("_n").cast("double"))), F.lit(1)))
    rows = rows.withColumn("_b", F.greatest(F.expr("(_n + _a - 1) div _a"), F.lit(1)))
    rows = rows.withColumns({"_l": F.expr("_x div _b"), "_r": F.expr("_x % _b")})
    l, r, a, b, s = (F.col(c) for c in ("_l", "_r", "_a", "_b", "_seed"))
    for k in range(ROUNDS):
        changed = _round(l, r, a, b, s, k)[k % 2]
        rows = rows.withColumn("_r" if k % 2 else "_l", changed)
    y = F.col("_l") * F.col("_b") + F.col("_r")
    # at most a cells lie behind the last place, so a walk ends within as many steps
    walk = F.aggregate(F.sequence(F.lit(1).cast("bigint"), a), y, lambda acc, _: F.when(acc < F.col("_n"), acc).otherwise(_once(acc, a, b, s)))
    return rows.withColumn("_y", y).withColumn(out, F.when(F.col("_y") < F.col("_n"), F.col("_y")).when(F.col("_y").isNotNull(), walk)).drop(*names, "_y")


def sql_permuted(rows: str, key: str, place: str, n: str, seed: str) -> str:
    """The same as SQL: common table expressions that end with ``permuted(<key>, x)`` for the rows of ``rows``; ``key`` may be several columns."""

    def once(x: str, source: str) -> str:
        inner = f"SELECT {key}, n, seed, a, b, ({x}) // b AS l, ({x}) % b AS r FROM {source}"
        for k in range(ROUNDS):
            of = "l" if k % 2 else "r"
            shift = f"('0x' || substr(md5(seed || ':{k}:' || {of}), 1, 8))::BIGINT"
            l, r = ("l", f"(r + {shift}) % b") if k % 2 else (f"(l + {shift}) % a", "r")
            inner = f"SELECT {key}, n, seed, a, b, {l} AS l, {r} AS r FROM ({inner})"
        return f"SELECT {key}, n, seed, a, b, l * b + r AS x FROM ({inner})"

    sized = f"SELECT {key}, ({place})::BIGINT AS x, ({n})::BIGINT AS n, ({seed})::VARCHAR AS seed, greatest(ceil(sqrt(({n})::DOUBLE)), 1)::BIGINT AS a FROM {rows}"
    return f"""sized AS (SELECT *, greatest((n + a - 1) // a, 1) AS b FROM ({sized})), walked AS ({once('x', 'sized')} UNION ALL {once('x', '(SELECT * FROM walked WHERE x >= n)')}),
  permuted AS (SELECT {key}, x FROM walked WHERE x < n)"""
