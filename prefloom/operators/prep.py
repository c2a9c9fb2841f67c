"""Dataset preparation: prefixes, splits, shuffles, templates, truncation, padding and masks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from prefloom.functions import text
from prefloom.functions.common import col, hash_order, hash_share
from prefloom.functions.permute import permuted
from prefloom.operators.ordering import positions
from prefloom.session import keep


def first_n(df: DataFrame, n: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``n`` rows along ``order`` (each task keeps its own first ``n``)."""
    return df.orderBy(*order).limit(n)


def split(df: DataFrame, key: str, test: float = 0.3, evaluation: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``part``: test, eval or train, from hash thresholds on the key. No shuffle; shares are expected values."""
    part = (
        F.when(hash_share(key, seed) < test, "test")
        .when(hash_share(key, seed + 1) < evaluation, "eval")
        .otherwise("train")
    )
    return df.withColumn("part", part)


def last_of_first(df: DataFrame, key: str, n: Column, seed: int) -> Row | None:
    """Hash and key of the last of the first rows in seeded hash order, ``n`` of them by a count expression.

    One pass counts the rows by the leading digits of the hash (at most 65,536 counts) and finds the digits where the ``n``-th row lies; only the rows
    with these digits are ranked."""
    hashed = df.select(hash_order(key, seed).alias("h"), F.col(key).alias("k")).withColumn("b", F.substring("h", 1, 4))
    counts = hashed.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    total = counts.agg(n.alias("n")).scalar()
    placed = counts.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("n", total)
    at = placed.filter((F.col("before") < F.col("n")) & (F.col("n") <= F.col("before") + F.col("m"))).first()
    if at is None:
        return None
    rank = int(at["n"] - at["before"])
    return hashed.filter(F.col("b") == at["b"]).orderBy("h", "k").limit(rank).orderBy(F.desc("h"), F.desc("k")).first()


def split_exact(df: DataFrame, key: str, test: float = 0.3, evaluation: float = 0.1, seed: int = 42) -> DataFrame:
    """As :func:`split` with exact sizes: ``ceil(n·test)`` rows, then ``ceil(rest·evaluation)`` of the rest. Keys are unique. The bounds are
    found beforehand on the keys alone; the rows are read once and told apart by their own hash, without a shuffle."""

    def within(last: Row | None, s: int) -> Column:
        if last is None:
            return F.lit(False)
        return F.struct(hash_order(key, s).alias("h"), F.col(key).alias("k")) <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).cast(df.schema[key].dataType).alias("k"))

    first = within(last_of_first(df, key, F.ceil(F.sum("m") * test), seed), seed)
    second = within(last_of_first(df.filter(~first), key, F.ceil(F.sum("m") * evaluation), seed + 1), seed + 1)
    return df.withColumn("part", F.when(first, "test").when(second, "eval").otherwise("train"))


def floor_to_multiple(df: DataFrame, k: int, idx: str = "idx") -> DataFrame:
    """Rows with index below the largest multiple of ``k`` that fits."""
    n = df.agg(F.floor(F.count(F.lit(1)) / k) * k).scalar()
    return df.filter(F.col(idx) < n)


def shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "position") -> DataFrame:
    """Seeded permutation as a ``position`` column (hash order, ties by key)."""
    hashed = df.withColumn("_h", hash_order(key, seed))
    return positions(hashed, ["_h", key], out=out).drop("_h")


def shuffle_places(df: DataFrame, idx: str, n: Column | int, seed: Column | int = 42, out: str = "position") -> DataFrame:
    """:func:`shuffle` for rows that are numbered from 0 already: no sort and no shuffle. ``n`` (rows) and ``seed`` may differ by group."""
    return permuted(df, idx, n, seed, out)


def split_places(df: DataFrame, idx: str, n: Column | int, test: float = 0.3, evaluation: float = 0.1, seed: Column | int = 42) -> DataFrame:
    """:func:`split_exact` for numbered rows, in one pass: the first ``ceil(n·test)`` places of a seeded permutation, then ``ceil(rest·evaluation)``."""
    count = F.lit(n) if isinstance(n, int) else n
    first = F.ceil(count * F.lit(test))
    second = first + F.ceil((count - first) * F.lit(evaluation))
    out = permuted(df, idx, n, seed, "_place")
    return out.withColumn("part", F.when(F.col("_place") < first, "test").when(F.col("_place") < second, "eval").otherwise("train")).drop("_place")


def with_prefix(df: DataFrame, column: str, prefix: str, out: str = "prompt") -> DataFrame:
    return df.withColumn(out, F.concat(F.lit(prefix), F.col(column)))


def reward_input(kind: str, prompt: Column, body: Column) -> Column:
    """Input text of a scorer; ``body`` is the answer text or, for segment kinds, the array of segments."""
    if kind == "completeness":
        return F.concat(text.collapse_spaces(prompt), F.lit(" answer: "), body)
    segments = F.array_join(F.transform(body, lambda s: F.concat(F.lit("</s> "), s)), " ")
    if kind == "verbosity":
        return F.concat(F.lit("question: "), prompt, F.lit(" answer: "), segments)
    if kind == "factuality":
        return F.concat(prompt, F.lit(" answer: "), segments)
    raise ValueError(f"unknown reward input kind {kind!r}")


def is_short(toks: Column, min_len: int = 2) -> Column:
    return F.size(toks) <= min_len


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Columns the consumer accepts, plus label, query and response, in table order."""
    allowed = {*wanted, "label", "query", "response"}
    return df.select(*[c for c in df.columns if c in allowed])


def length_before(toks: Column, eos: int) -> Column:
    """Tokens before the first EOS, or all of them."""
    at = F.array_position(toks, F.lit(eos))
    return F.when(at > 0, at - 1).otherwise(F.size(toks)).cast("int")


def cut_at_eos(toks: Column, eos: int, keep: bool) -> Column:
    """Tokens up to the first EOS, with or without it."""
    n = length_before(toks, eos)
    return F.slice(toks, 1, F.least(n + 1, F.size(toks)) if keep else n)


def pad_response(toks: Column, max_len: Column | int, pad: int = 0) -> Column:
    """Drop the begin token, then pad at the right to ``max_len − 1`` tokens. A longer answer raises an error: nothing is cut."""
    body = F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0)))
    n = F.lit(max_len) if isinstance(max_len, int) else max_len
    fits = F.concat(body, F.array_repeat(F.lit(pad), (n - 1 - F.size(body)).cast("int")))
    return F.when(F.size(toks) > n, F.raise_error(F.lit("pad_response: an answer is longer than max_len"))).otherwise(fits)


def attention(toks: Column, pad: int = 0) -> Column:
    return F.transform(toks, lambda t: (t != pad).cast("int"))


def swap_id(toks: Column, old: int, new: int) -> Column:
    """Replace one id by another; used for pad → −100 in labels and back."""
    return F.transform(toks, lambda t: F.when(t == old, F.lit(new)).otherwise(t))


def validate_rollouts(df: DataFrame, key: str, batch_size: int | None, arrays: Sequence[str]) -> DataFrame:
    """One row per problem: arrays of unequal length, null entries, or batches that are not ``batch_size`` rows."""
    first = arrays[0]
    checks = [
        F.struct(
            F.lit(f"{a} and {first} differ in length").alias("problem"), (F.size(a) != F.size(first)).alias("bad")
        )
        for a in arrays[1:]
    ] + [
        F.struct(F.lit(f"{a} is missing or has null entries").alias("problem"),
                 F.coalesce(F.exists(a, lambda x: x.isNull()), F.lit(True)).alias("bad"))
        for a in arrays
    ]
    rows = df.select(F.col(key).cast("string").alias("where"), F.inline(F.array(*checks))).filter("bad")
    found = rows.select("where", "problem")
    if batch_size is not None:
        sizes = df.groupBy(F.col("batch").cast("string").alias("where")).count().filter(F.col("count") != batch_size)
        found = found.unionByName(
            sizes.select("where", F.format_string(f"batch has %d rows instead of {batch_size}", "count").alias("problem"))
        )
    return found


def tokenize(df: DataFrame, column: str, max_len: int, pattern: str = text.TOKEN, vocab: int = 50_000) -> DataFrame:
    """Adds ``input_ids`` cut to ``max_len`` and ``attention_mask``; drops the text."""
    ids = text.token_ids(F.slice(text.tokens(column, pattern), 1, max_len), vocab)
    return df.withColumn("input_ids", ids).withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1))).drop(column)


def postprocess(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Stripped predictions, references as one-element lists."""
    strip = lambda c: F.regexp_replace(F.regexp_replace(col(c), r"^\s+", ""), r"\s+$", "")
    return df.withColumn(prediction, strip(prediction)).withColumn(reference, F.array(strip(reference)))


def strip_prompt(generated: Column, prompt_mask: Column) -> Column:
    """Generated ids without left padding and without the prompt."""
    return F.slice(generated, F.size(prompt_mask) + 1, F.greatest(F.size(generated) - F.size(prompt_mask), F.lit(0)))


def ones(n: Column) -> Column:
    return F.array_repeat(F.lit(1), n.cast("int"))


def assemble(df: DataFrame, enc_dec: bool, query: str = "query_ids", response: str = "response_ids") -> DataFrame:
    """Model inputs: one joined sequence, or encoder and decoder sides; a ``labels`` column is dropped."""
    if enc_dec:
        out = (
            df.withColumn("input_ids", F.col(query))
            .withColumn("attention_mask", ones(F.size(query)))
            .withColumn("decoder_input_ids", F.col(response))
            .withColumn("decoder_attention_mask", ones(F.size(response)))
        )
    else:
        out = df.withColumn("input_ids", F.concat(query, response)).withColumn(
            "attention_mask", ones(F.size(query) + F.size(response))
        )
    return out.drop("labels", query, response)


def collate(
    df: DataFrame, batch: Sequence[str], columns: Mapping[str, tuple[int, str]], multiple: int = 1,
    shared: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """Pad array columns to the longest of their batch.

    ``columns`` maps a column to ``(pad value, "left" or "right")``; ``multiple`` rounds the length up; the columns
    of one ``shared`` group get a common length. Rows are made once and kept, and so are the lengths, one row per batch: the planner knows their
    size and broadcasts them below its threshold, so the arrays are not shuffled by batch.
    """
    df = keep(df, "rows")
    group_of = {c: next((tuple(g) for g in shared if c in g), (c,)) for c in columns}
    longest = df.groupBy(*batch).agg(*[F.max(F.size(c)).alias(f"_n_{c}") for c in columns])
    joined = df.join(keep(longest, "lengths"), list(batch))
    for c, (pad, side) in columns.items():
        sizes = [F.col(f"_n_{g}") for g in group_of[c]]
        n = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
        target = (F.ceil(n / multiple) * multiple).cast("int")
        fill = F.array_repeat(F.lit(pad), target - F.size(c))
        joined = joined.withColumn(f"_p_{c}", F.concat(fill, c) if side == "left" else F.concat(c, fill))
    return joined.select(*[F.col(f"_p_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
