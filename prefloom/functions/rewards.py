"""Reward arithmetic on numbers and on per-token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.common import col, let, pick, positions_of, zeros


def znorm(x: Column | str, mean, std, scale: float = 1.0, bias: float = 0.0) -> Column:
    """``((x − mean) / std) · scale + bias``; mean and std are numbers or columns."""
    return ((col(x) - mean) / std) * scale + bias


def shape(x: Column | str, sigmoid: bool = False, clip: float = 0.0) -> Column:
    """Logistic squashing less ``clip`` when ``sigmoid`` is on, otherwise the value itself."""
    x = col(x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x)) - F.lit(clip) if sigmoid else x.cast("double")


def last_token_reward(length: Column, score: Column) -> Column:
    """Zeros and then the score; length 0 still gives one element."""
    return F.concat(zeros(length - 1), F.array(score.cast("double")))


def add_to_last(rewards: Column, amount: Column) -> Column:
    return let(
        F.struct(rewards.alias("r"), F.size(rewards).alias("n"), amount.alias("a")),
        lambda s: F.transform(s["r"], lambda x, i: F.when(i == s["n"] - 1, x + s["a"]).otherwise(x)),
    )


# Class 2 is the correct one; each reward kind compares it with its own error class.
ERROR_CLASS = {"verbosity": 1, "factuality": 0}


def segment_correct(logits: Column, kind: str) -> Column:
    """True when the correct class beats the error class; a tie is an error."""
    return pick(logits, F.lit(2)) > pick(logits, F.lit(ERROR_CLASS[kind]))


def scatter(length: Column, segments: Column, positive: Column, negative: Column) -> Column:
    """Array of ``length`` zeros with the reward of the last segment ending at each position.

    ``segments`` is ``array<struct<seg, end_pos, correct>>``. Ends outside the array are left out. The
    positions are written through a map, so the work is one pass over the segments and one over the tokens.
    """
    def last_per_end(segs: Column) -> Column:
        # sorted by (end, seg) the last entry of each end is the one whose successor ends elsewhere
        by_end = F.sort_array(F.transform(segs, lambda s: F.struct(s["end_pos"].alias("e"), s["seg"].alias("s"), s["correct"].alias("c"))))
        return let(
            by_end,
            lambda sorted_: F.map_from_entries(
                F.transform(
                    F.filter(sorted_, lambda s, i: ~F.coalesce(F.get(sorted_, i + 1)["e"] == s["e"], F.lit(False))),
                    lambda s: F.struct(s["e"].alias("k"), F.when(s["c"], positive).otherwise(negative).alias("v")),
                )
            ),
        )

    index = F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return let(
        last_per_end(segments),
        lambda at: F.transform(index, lambda i: F.coalesce(F.try_element_at(at, i), F.lit(0.0))),
    )


def correct_rate(n_correct: Column, n_segments: Column) -> Column:
    """Share of correct segments; 0.5 when there are none."""
    return F.when(n_segments > 0, n_correct / n_segments).otherwise(F.lit(0.5))


def combine(a: Column, b: Column, c: Column, w: tuple[float, float, float]) -> Column:
    """Weighted element-wise sum, as long as the shortest array."""
    n = F.least(F.size(a), F.size(b), F.size(c))
    ab = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * w[0] + y * w[1])
    return F.zip_with(ab, F.slice(c, 1, n), lambda x, y: x + y * w[2])


def mt_aspect(grammar: Column, readability: Column, confidence: Column, w=(1.0, 1.0, 1.0), sigmoid: bool = False):
    """Grammar reward per token; readability and confidence join at the last token. ``w`` = grammar, read, confidence."""
    tail = F.lit(w[1]) * shape(readability, sigmoid) + F.lit(w[2]) * shape(confidence, sigmoid)
    return add_to_last(F.transform(grammar, lambda g: g * F.lit(w[0])), tail)


STRATEGIES = ("holistic_only", "aspect_only", "weighted_sum", "hierarchical")


def strategy(
    kind: str,
    aspect: Column,
    holistic: Column,
    length: Column,
    weight: float = 1.0,
    threshold: float = 0.5,
) -> Column:
    """Token rewards under one strategy; ``hierarchical`` adds aspects only from ``threshold`` on."""
    score = holistic * F.lit(weight)
    if kind == "holistic_only":
        return last_token_reward(length, score)
    if kind == "aspect_only":
        return aspect
    if kind == "weighted_sum":
        return add_to_last(aspect, score)
    if kind == "hierarchical":
        return F.when(holistic < F.lit(threshold), last_token_reward(length, score)).otherwise(
            add_to_last(aspect, score)
        )
    raise ValueError(f"unknown strategy {kind!r}; expected one of {', '.join(STRATEGIES)}")


SHORT_SCORE = -10.0  # fixed value: the holistic score of a response that is too short


def short_override(rewards: Column, too_short: Column, length: Column, weight: float = 1.0) -> Column:
    """Too short responses get ``weight · −10`` at the last token, whatever the strategy."""
    return F.when(too_short, last_token_reward(length, F.lit(SHORT_SCORE * weight))).otherwise(rewards)


def length_reward(length: Column, mean_length: float) -> Column:
    return last_token_reward(length, length / F.lit(mean_length))


def last_attended(values: Column, mask: Column) -> Column:
    """Value at the last position with mask 1; an all-zero mask picks position 0."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m == 1, i)))
    return pick(values, F.coalesce(last, F.lit(0)))


def mark_tokens(toks: Column, spans: Column, good: Column, bad: Column) -> Column:
    """Token rewards: ``bad`` on the tokens of each error span, ``good`` elsewhere.

    ``toks`` is ``array<struct<start, end>>`` in text order, ``spans`` is ``array<struct<offset, error_length>>``.
    A span begins at the first token that ends at or behind ``offset`` (offset 0: the first token) and takes
    further tokens while the text from its first token on is no longer than ``error_length``. A span behind the
    last token is skipped. Time is linear in the text: a lookup array gives the token for each character.
    """
    return let(
        F.struct(toks.alias("t"), spans.alias("s")),
        lambda x: _mark(x["t"], x["s"], good, bad),
    )


def _mark(toks: Column, spans: Column, good: Column, bad: Column) -> Column:
    n = F.size(toks)
    token_at = F.flatten(
        F.transform(
            toks,
            lambda t, i: F.array_repeat(
                i, t["end"] - F.when(i > 0, F.get(toks, i - 1)["end"]).otherwise(F.lit(0))
            ),
        )
    )

    def span_tokens(at: Column) -> Column:
        first = F.transform(
            spans,
            lambda m: F.struct(
                F.when(m["offset"] <= 0, F.lit(0)).otherwise(F.get(at, m["offset"] - 1)).alias("first"),
                m["error_length"].alias("n"),
            ),
        )
        both = F.transform(
            F.filter(first, lambda m: m["first"].isNotNull() & (n > 0)),
            lambda m: F.struct(
                m["first"].alias("first"),
                F.coalesce(F.get(at, F.get(toks, m["first"])["start"] + m["n"]) - 1, n - 1).alias("last"),
            ),
        )
        return F.array_distinct(
            F.flatten(
                F.transform(
                    F.filter(both, lambda m: m["last"] >= m["first"]), lambda m: F.sequence(m["first"], m["last"])
                )
            )
        )

    # sorted together, a marked token i shows up as the neighbours 2i, 2i+1
    def flags(marked: Column) -> Column:
        mixed = F.sort_array(
            F.concat(F.transform(positions_of(toks), lambda i: i * 2), F.transform(marked, lambda i: i * 2 + 1))
        )
        return let(
            mixed,
            lambda both: F.filter(
                F.transform(
                    both,
                    lambda x, j: F.when(x % 2 == 1, F.lit(None).cast("double"))
                    .when(F.get(both, j + 1) == x + 1, bad)
                    .otherwise(good),
                ),
                lambda r: r.isNotNull(),
            ),
        )

    return let(token_at, lambda at: let(span_tokens(at), flags))
