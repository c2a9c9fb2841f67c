"""Per-token and per-sequence statistics as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.common import asum, let, parted, pick, scan, zeros


def _exp_sum(a: Column, top: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))


def logsumexp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.ln(_exp_sum(a, m)))


def log_softmax(a: Column) -> Column:
    return let(logsumexp(a), lambda z: F.transform(a, lambda x: x - z))


def logprob(logits: Column, label: Column) -> Column:
    """Log-probability of the class ``label`` (zero-based)."""
    return pick(logits, label) - logsumexp(logits)


def entropy(logits: Column) -> Column:
    return let(
        logsumexp(logits), lambda z: z - F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - z) * x)
    )


def response_mask(attention: Column, enc_dec: bool, query_len: Column | None = None, response_len: Column | None = None) -> Column:
    """Mask over the predicted positions ``0 .. T−2`` of one sequence with attention mask ``attention``.

    Encoder-decoder: from 1 up to the attended length less one. Decoder: the response, whose first token is
    predicted at ``query_len − 1``, behind any left padding.
    """
    if enc_dec:
        start, end = F.lit(1), F.aggregate(attention, F.lit(0), lambda s, x: s + x) - 1
    else:
        start = query_len - 1 + F.greatest(F.array_position(attention, F.lit(1)).cast("int") - 1, F.lit(0))
        end = start + response_len
    shifted = F.slice(attention, 2, F.greatest(F.size(attention) - 1, F.lit(0)))
    return let(
        F.struct(start.alias("s"), end.alias("e")),
        lambda b: F.transform(shifted, lambda m, i: F.when((i >= b["s"]) & (i < b["e"]), m).otherwise(0)),
    )


KL_KINDS = ("kl", "abs", "mse", "full")


def kl_penalty(lp: Column, ref: Column, kind: str = "kl") -> Column:
    """Penalty of one token; for ``full`` both sides are the whole log-probability rows over the vocabulary."""
    if kind == "kl":
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind == "mse":
        return (lp - ref) * (lp - ref) * 0.5
    if kind == "full":
        return asum(F.zip_with(lp, ref, lambda p, q: F.exp(p) * (p - q)))
    raise ValueError(f"unknown KL kind {kind!r}; expected one of {', '.join(KL_KINDS)}")


def right_align(a: Column, n: Column) -> Column:
    """Zeros to the left up to length ``n``."""
    return F.concat(zeros(n - F.size(a)), a)


def token_rewards(lp: Column, ref: Column, scores: Column, beta: Column | float, kind: str = "kl") -> Column:
    """``−beta · penalty`` per token plus the right-aligned scores."""
    penalty = F.zip_with(lp, ref, lambda a, b: kl_penalty(a, b, kind))
    return F.zip_with(penalty, right_align(scores, F.size(lp)), lambda k, s: -(k * beta) + s)


def masked(a: Column, mask: Column) -> Column:
    return F.zip_with(a, mask, lambda x, m: x * m)


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantage estimates, from the last token to the first.

    The recursion is linear, so the reversed tokens are folded in parts that start at zero, and each part then gets the advantage
    behind it times the decay over the distance."""
    decay = gamma * lam

    def deltas(v: Column) -> Column:
        following = F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.array(F.lit(0.0)))
        steps = F.zip_with(masked(rewards, mask), F.zip_with(v, following, lambda a, b: b * gamma - a), lambda r, d: r + d)
        return F.reverse(F.slice(steps, 1, F.size(v)))

    def join(local: Column) -> Column:
        ends = F.transform(local, lambda p: F.struct(F.element_at(p, -1).alias("a"), F.pow(F.lit(decay), F.size(p)).alias("f")))
        carry = F.concat(F.array(F.lit(0.0)), scan(ends, F.lit(0.0), lambda s, e: e["a"] + e["f"] * s, "double"))
        return F.flatten(
            F.zip_with(local, F.slice(carry, 1, F.size(local)), lambda p, c: F.transform(p, lambda x, i: x + F.pow(F.lit(decay), i + 1) * c))
        )

    parts = let(let(masked(values, mask), deltas), lambda a: parted(a))
    return F.reverse(let(F.transform(parts, lambda p: scan(p, F.lit(0.0), lambda s, d: d + s * decay, "double")), join))


def returns(advantages: Column, values: Column, mask: Column) -> Column:
    return F.zip_with(advantages, masked(values, mask), lambda a, v: a + v)


def clip(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(F.least(x, hi), lo)
