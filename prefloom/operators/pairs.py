"""Preference pairs and supervised data: losses, features, completion masks, packing, selection."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.functions import stats
from prefloom.functions.common import hash_int, hash_order, let, positions_of, ratio
from prefloom.operators.ordering import in_parts, running
from prefloom.operators.prep import collate, ones
from prefloom.session import keep

IGNORE = -100  # fixed value: the label that losses skip


def softplus(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def pair_loss(chosen: Column, rejected: Column) -> Column:
    """``−ln σ(chosen − rejected)``."""
    return softplus(rejected - chosen)


def pair_prob(chosen: Column, rejected: Column) -> Column:
    """Probability that the chosen side is preferred."""
    return F.exp(-pair_loss(chosen, rejected))


def pair_report(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Mean loss and accuracy; a tie counts as correct."""
    c, r = F.col(chosen), F.col(rejected)
    return df.agg(F.avg(pair_loss(c, r)).alias("loss"), F.avg((c >= r).cast("double")).alias("accuracy"))


def sequence_logp(df: DataFrame, seq: str, pos: str, logits: str, label: str) -> DataFrame:
    """Log-probability of each sequence: the logits of a position score the next label; −100 labels are skipped.

    Sum and mean per token; a sequence whose labels are all skipped has sum 0 and a null mean.
    """
    scores = df.select(seq, pos, logits)
    labels = df.select(seq, (F.col(pos) - 1).alias(pos), label)
    lp = F.when(F.col(label) != IGNORE, stats.logprob(F.col(logits), F.col(label)))
    per_token = scores.join(labels, [seq, pos]).select(seq, lp.alias("_lp"))
    return per_token.groupBy(seq).agg(F.coalesce(F.sum("_lp"), F.lit(0.0)).alias("logp_sum"), F.avg("_lp").alias("logp_mean"))


def dpo(df: DataFrame, beta: float = 0.1, reference_free: bool = False) -> DataFrame:
    """Adds ``loss, reward_chosen, reward_rejected``; ``reference_free`` affects the loss only."""
    c = F.col
    margin = c("policy_chosen") - c("policy_rejected")
    if not reference_free:
        margin = margin - (c("ref_chosen") - c("ref_rejected"))
    return (
        df.withColumn("loss", softplus(-(margin * beta)))
        .withColumn("reward_chosen", (c("policy_chosen") - c("ref_chosen")) * beta)
        .withColumn("reward_rejected", (c("policy_rejected") - c("ref_rejected")) * beta)
    )


def dpo_report(df: DataFrame, prefix: str = "", by: Sequence[str] = ()) -> DataFrame:
    """Means over a :func:`dpo` table; accuracy asks for a strictly greater chosen reward."""
    c = F.col
    rows = {
        "loss": c("loss"),
        "rewards/chosen": c("reward_chosen"),
        "rewards/rejected": c("reward_rejected"),
        "rewards/accuracies": (c("reward_chosen") > c("reward_rejected")).cast("double"),
        "rewards/margins": c("reward_chosen") - c("reward_rejected"),
        "logps/chosen": c("policy_chosen"),
        "logps/rejected": c("policy_rejected"),
    }
    return df.groupBy(*by).agg(*[F.avg(x).alias(prefix + name) for name, x in rows.items()])


def metric_flush(df: DataFrame, is_log: Column, order: Sequence[str], key: str, value: str) -> DataFrame:
    """Mean of each metric between two log events: ``flush, key, mean``; flush counts the log events before it."""
    counted = running(df.withColumn("_log", is_log), is_log.cast("bigint"), "flush", order)
    return counted.filter(~F.col("_log")).groupBy("flush", key).agg(F.avg(value).alias("mean"))


def dpo_features(
    df: DataFrame, max_len: int, max_prompt: int, mode: str = "keep_end", eos: int = 1,
    prompt: str = "prompt_ids", chosen: str = "chosen_ids", rejected: str = "rejected_ids",
) -> DataFrame:
    """Adds ids, masks and labels of both sequences and of the prompt; the prompt gives way before the responses."""
    if mode not in ("keep_start", "keep_end"):
        raise ValueError(f"unknown truncation mode {mode!r}")

    def checked(name: str) -> Column:
        return F.when(
            F.array_contains(name, F.lit(eos)), F.raise_error(F.lit(f"{name} contains the EOS id")).cast("array<int>")
        ).otherwise(F.col(name))

    def with_eos(name: str) -> Column:
        return F.concat(checked(name), F.array(F.lit(eos)))

    base = df.withColumn("_p", checked(prompt)).withColumn("_c", with_eos(chosen)).withColumn("_r", with_eos(rejected))
    base = base.withColumn("_longest", F.greatest(F.size("_c"), F.size("_r")))
    kept = F.slice("_p", 1, max_prompt) if mode == "keep_start" else F.slice(
        "_p", F.greatest(F.size("_p") - max_prompt + 1, F.lit(1)), F.lit(max_prompt)
    )
    base = base.withColumn("_p", F.when(F.size("_p") + F.col("_longest") > max_len, kept).otherwise(F.col("_p")))
    too_long = F.size("_p") + F.col("_longest") > max_len
    for side in ("_c", "_r"):
        base = base.withColumn(f"{side}t", F.when(too_long, F.slice(side, 1, max_len - max_prompt)).otherwise(F.col(side)))
    ignored = F.array_repeat(F.lit(IGNORE), F.size("_p"))
    out = base
    for name, side in (("chosen", "_ct"), ("rejected", "_rt")):
        out = (
            out.withColumn(f"{name}_input_ids", F.concat("_p", side))
            .withColumn(f"{name}_attention_mask", ones(F.size("_p") + F.size(side)))
            .withColumn(f"{name}_labels", F.concat(ignored, side))
        )
    out = out.withColumn("prompt_input_ids", F.col("_p")).withColumn("prompt_attention_mask", ones(F.size("_p")))
    return out.drop("_p", "_c", "_r", "_ct", "_rt", "_longest")


def collate_dpo(df: DataFrame, batch: Sequence[str], pad: int = 0) -> DataFrame:
    """Pad a features table by batch: prompts at the left, sequences at the right."""
    fill = {"input_ids": pad, "attention_mask": 0, "labels": IGNORE}
    columns = {
        c: (value, "left" if c.startswith("prompt") else "right")
        for c in df.columns for ending, value in fill.items() if c.endswith(f"_{ending}")
    }
    return collate(df, batch, columns)


REWARD_COLUMNS = ("input_ids_chosen", "attention_mask_chosen", "input_ids_rejected", "attention_mask_rejected")


def reward_collate(df: DataFrame, batch: Sequence[str], multiple: int = 1, pad: int = 0) -> DataFrame:
    """Pad chosen and rejected each to their batch maximum (rounded up to ``multiple``)."""
    missing = [c for c in REWARD_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return collate(df, batch, {c: (pad if c.startswith("input") else 0, "right") for c in REWARD_COLUMNS}, multiple)


def concat_pairs(df: DataFrame, keys: Sequence[str], batch: Sequence[str], pad: int = 0) -> DataFrame:
    """Chosen rows above rejected rows, padded to the longest of both in the batch, with a ``side`` column."""
    names = {"input_ids": pad, "attention_mask": 0, "labels": IGNORE}
    columns = {f"{side}_{n}": (value, "right") for n, value in names.items() for side in ("chosen", "rejected")}
    even = collate(df, batch, columns, shared=[(f"chosen_{n}", f"rejected_{n}") for n in names])
    keep = list(dict.fromkeys([*keys, *batch]))
    sides = [
        even.select(*keep, F.lit(side).alias("side"), *[F.col(f"{side}_{n}").alias(n) for n in names])
        for side in ("chosen", "rejected")
    ]
    return sides[0].unionByName(sides[1])


def occurrences(ids: Column, marker: Sequence[int]) -> Column:
    """Zero-based starts of ``marker`` inside an id array."""
    m = F.array(*[F.lit(x) for x in marker])
    return let(ids, lambda a: F.filter(positions_of(a), lambda i: F.slice(a, i + 1, F.lit(len(marker))) == m))


def completion_mask(ids: Column, response: Sequence[int], instruction: Sequence[int] | None = None) -> Column:
    """Labels that keep only completions.

    With a response marker alone everything through its last occurrence is ignored. With an instruction marker
    the k-th instruction is paired with the k-th response end and that span is ignored (the first from 0 on);
    when responses are fewer, everything from the last instruction on is ignored too. A sequence without the
    required marker raises an error.
    """
    def missing(what: str) -> Column:
        return F.raise_error(F.lit(f"completion_mask: a sequence has no {what} marker")).cast("array<int>")

    found = F.struct(
        ids.alias("ids"),
        F.transform(occurrences(ids, response), lambda i: i + len(response)).alias("ends"),
        (occurrences(ids, instruction) if instruction else F.array().cast("array<int>")).alias("starts"),
    )
    if instruction is None:
        return let(
            found,
            lambda f: F.when(F.size(f["ends"]) == 0, missing("response")).otherwise(
                let(
                    F.struct(F.array_max(f["ends"]).alias("e"), f["ids"].alias("ids")),
                    lambda g: F.transform(g["ids"], lambda t, i: F.when(i < g["e"], F.lit(IGNORE)).otherwise(t)),
                )
            ),
        )

    def ignore(f: Column) -> Column:
        n = F.least(F.size(f["starts"]), F.size(f["ends"]))
        spans = F.zip_with(
            F.slice(f["starts"], 1, n), F.slice(f["ends"], 1, n), lambda s, e: F.struct(s.alias("s"), e.alias("e"))
        )
        spans = F.transform(spans, lambda x, k: F.struct(F.when(k == 0, 0).otherwise(x["s"]).alias("s"), x["e"].alias("e")))
        tail = F.when(
            F.size(f["ends"]) < F.size(f["starts"]),
            F.array(F.struct(F.element_at(f["starts"], -1).alias("s"), F.size(f["ids"]).alias("e"))),
        ).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
        return let(
            F.struct(F.concat(spans, tail).alias("spans"), f["ids"].alias("ids")),
            lambda g: F.transform(
                g["ids"],
                lambda t, i: F.when(F.exists(g["spans"], lambda x: (i >= x["s"]) & (i < x["e"])), F.lit(IGNORE)).otherwise(t),
            ),
        )

    return let(found, lambda f: F.when(F.size(f["starts"]) == 0, missing("instruction")).otherwise(ignore(f)))


def _chunks(placed: DataFrame, seq_len: int, keys: Sequence[str]) -> DataFrame:
    """Cut id arrays ``_ids`` that start at token ``_start`` of their stream into full chunks of ``seq_len``."""
    rows = placed.withColumn("_last", F.col("_start") + F.size("_ids") - 1)
    parts = rows.withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("_start") / seq_len), F.floor(F.col("_last") / seq_len)))
    )
    first = F.greatest(F.col("chunk") * seq_len - F.col("_start"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk") + 1) * seq_len - F.col("_start"), F.size("_ids")).cast("int")
    piece = F.struct(F.col("_start").alias("at"), F.slice("_ids", first + 1, end - first).alias("ids"))
    gathered = parts.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    full = gathered.select(*keys, "chunk", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("input_ids"))
    return full.filter(F.size("input_ids") == seq_len).withColumn("labels", F.col("input_ids"))


def pack(df: DataFrame, key: str, ids: Column, length: Column, seq_len: int, eos: int) -> DataFrame:
    """Concatenate texts in key order, each followed by ``eos``, and cut into chunks: ``chunk, input_ids, labels``.

    ``ids`` and ``length`` are the token ids and their number. Start offsets are running sums over (key, length)
    alone, kept in the shared folder so that lengths are counted once; the texts join them by key, and each chunk gathers at most ``seq_len`` tokens. The incomplete last
    chunk is dropped.
    """
    sizes = keep(df.select(key, (length + 1).cast("bigint").alias("_n")), "sizes")
    starts = running(sizes, F.col("_n"), "_start", [key], inclusive=False).select(key, "_start")
    # ids are made before the join, in the partitions of the texts, whichever side the join then moves
    made = df.select(key, F.concat(ids, F.array(F.lit(eos))).alias("_ids"))
    return _chunks(made.join(starts, key), seq_len, [])


def buffer_ends(before: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of a part as the first start in it, by doubling the pointers to the next start: the sum from which the next start lies behind the
    part, the number of starts in it, and the pointers. ``before`` are the characters before each row."""
    n = len(before)
    following = np.searchsorted(before, before + budget, side="left")
    step = np.where(following < n, following, np.arange(n))
    last, count = step, np.where(following < n, 1, 0)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return before[last] + budget, count + 1, following
        last, count = further, count + count[last]


def buffers_of(sizes: DataFrame, buffer_chars: float, rows: int | None = None) -> DataFrame:
    """``shard, key, n, buffer``: buffers of each shard in key order, each closed once it holds ``buffer_chars`` characters. ``sizes`` has ``shard, key,
    chars, n``, stored.

    A start follows its last one at the first row that has ``buffer_chars`` more characters before it, so the next start is a function of the characters
    before a row. Each part of a shard works it out for all rows that may be its first start, those in its first ``buffer_chars`` characters; entries with one
    outcome are one step of the function. The functions of the parts, a few steps each, are composed along the shard, and each part then numbers its rows."""
    budget = math.ceil(buffer_chars)
    if budget < 1:
        raise ValueError("a buffer holds at least one character")
    cut = in_parts(sizes, [F.col("key")], ["shard"], rows).select("shard", "key", "chars", "n", F.col("_part").alias("part"))
    totals = cut.groupBy("shard", "part").agg(F.sum("chars").alias("_sum"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = keep(totals.select("shard", "part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("base")), "bases")
    placed = cut.join(bases, ["shard", "part"])

    def ordered(part: pa.Table) -> tuple[pa.Table, np.ndarray]:
        part = part.sort_by("key")
        chars = part.column("chars").to_numpy()
        return part, int(part.column("base")[0].as_py()) + np.cumsum(chars) - chars

    def outcomes(part: pa.Table) -> pa.Table:
        part, before = ordered(part)
        onward, count, _ = buffer_ends(before, budget)
        # the last start before the part lies before its first row, so the next one is at most the first row ``budget`` characters on
        first = np.arange(min(len(before), int(np.searchsorted(before, before[0] + budget, side="left")) + 1))
        # of rows with one number of characters before them the first one is found
        _, at = np.unique(before[first], return_index=True)
        change = np.flatnonzero(np.concatenate([(onward[at][1:] != onward[at][:-1]) | (count[at][1:] != count[at][:-1]), [True]]))
        at = at[change]
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (before[at], onward[at], count[at])]
        return pa.Table.from_arrays([part.column("shard").slice(0, 1), part.column("part").slice(0, 1), *lists, pa.array([int(before[0])]), pa.array([int(before[-1])])], names=["shard", "part", "upto", "onward", "count", "low", "high"])

    made = keep(placed.groupBy("shard", "part").applyInArrow(outcomes, "shard bigint, part int, upto array<bigint>, onward array<bigint>, count array<bigint>, low bigint, high bigint"), "outcomes")

    def composed(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")
        enter, number, out = None, 0, []
        for row in parts.to_pylist():
            enter = row["low"] if enter is None else enter
            out.append((row["shard"], row["part"], enter, number))
            if enter <= row["high"]:
                step = bisect_left(row["upto"], enter)
                enter, number = row["onward"][step], number + row["count"][step]
        columns = zip(*out, strict=True)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["shard", "part", "enter", "number"])

    entries = made.groupBy("shard").applyInArrow(composed, "shard bigint, part int, enter bigint, number bigint")

    def numbered(part: pa.Table) -> pa.Table:
        part, before = ordered(part)
        enter, number = (int(part.column(c)[0].as_py()) for c in ("enter", "number"))
        _, _, following = buffer_ends(before, budget)
        starts, at = np.zeros(len(before), np.int64), int(np.searchsorted(before, enter, side="left"))
        while at < len(before):  # once for each buffer
            starts[at] = 1
            at = int(following[at])
        return pa.Table.from_arrays([part.column("shard"), part.column("key"), part.column("n"), pa.array(number + np.cumsum(starts) - 1)], names=["shard", "key", "n", "buffer"])

    return placed.join(entries, ["shard", "part"]).groupBy("shard", "part").applyInArrow(numbered, "shard bigint, key bigint, n bigint, buffer bigint")


def pack_buffered(
    df: DataFrame, key: str, ids: Column, length: Column, chars: Column, seq_len: int, eos: int,
    buffer_chars: float, shard: Column, seed: int = 42, rows: int | None = None,
) -> DataFrame:
    """Packing by buffers: each shard fills buffers up to ``buffer_chars`` characters or just above, in key order.

    A shard is what one reader of the data set takes, so the caller says which; buffers end with their shard. The tail of every buffer is
    dropped and its chunks are put in seeded random order (``position``). A shard of any size is worked on in parts, see :func:`buffers_of`.
    """
    sizes = keep(
        df.select(
            shard.cast("bigint").alias("shard"), F.col(key).cast("bigint").alias("key"),
            chars.cast("bigint").alias("chars"), (length + 1).cast("bigint").alias("n"),
        ),
        "sizes",
    )
    buffers = buffers_of(sizes, buffer_chars, rows)
    w = Window.partitionBy("shard", "buffer").orderBy("key")
    starts = buffers.select(F.col("key").alias(key), "shard", "buffer", (F.sum("n").over(w) - F.col("n")).alias("_start"))
    made = df.select(key, F.concat(ids, F.array(F.lit(eos))).alias("_ids"))
    chunks = _chunks(made.join(starts, key), seq_len, ["shard", "buffer"])
    mixed = Window.partitionBy("shard", "buffer").orderBy(hash_order("chunk", seed), "chunk")
    return chunks.withColumn("position", F.row_number().over(mixed) - 1)


def pack_plan(df: DataFrame, column: str, count: Column, seq_len: int, n_sequences: int) -> DataFrame:
    """Characters per token of the table and the buffer size in characters they give."""
    per = df.agg(ratio(F.sum(F.length(column)), F.sum(count)).alias("chars_per_token"))
    return per.withColumn("buffer_chars", F.col("chars_per_token") * seq_len * n_sequences)


def best_of_n(df: DataFrame, query: str, candidate: str, score: str, n: int) -> DataFrame:
    """The ``n`` best candidates per query with their ``rank``; tasks drop the others before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(candidate))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def length_draw(key: Column | str, lo: int, hi: int, seed: int = 42) -> Column:
    """Whole number in ``[lo, hi)`` drawn by hash."""
    return F.lit(lo) + hash_int(key, seed) % (hi - lo)


def pad_batch(df: DataFrame, ids: str, batch: Sequence[str]) -> DataFrame:
    """Ids and mask padded with 0 to the batch maximum."""
    return collate(df.withColumn("attention_mask", ones(F.size(ids))), batch, {ids: (0, "right"), "attention_mask": (0, "right")})


