"""Text operators that need more than one row or an explode: readability, language, errors, BLEU, segments."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from prefloom.functions import automaton, batches, grammar, text
from prefloom.functions.common import col, prefix_sums
from prefloom.session import keep


def segments(df: DataFrame, column: str, cuts: Column, length: Column) -> DataFrame:
    """One row per segment: ``seg, start, end, segment, end_pos``.

    ``end_pos`` is the token count of the text up to the segment's end, less one, clipped to ``length − 1``.
    Cuts lie between tokens, so the prefix count is the running sum of the segments' own counts. A text without segments gives one row
    with null ``seg``.
    """
    pieces = text.slices(F.col(column), cuts)
    ends = F.transform(prefix_sums(F.transform(F.col("_pieces"), lambda p: text.token_count(p["text"]))), lambda n: n - 1)
    rows = df.withColumn("_pieces", pieces).withColumn("_ends", ends).withColumn("_len", length)
    keep = [F.col(c) for c in df.columns]
    return rows.select(
        *keep, "_len", F.posexplode_outer(F.arrays_zip(F.col("_pieces").alias("p"), F.col("_ends").alias("e"))).alias("seg", "x")
    ).select(
        *keep, F.col("seg").cast("bigint").alias("seg"), F.col("x.p.start").alias("start"), F.col("x.p.end").alias("end"),
        F.col("x.p.text").alias("segment"), F.when(F.col("seg").isNotNull(), F.least(F.col("x.e"), F.col("_len") - 1)).alias("end_pos"),
    )


def readability(df: DataFrame, key: str, column: str, familiar: DataFrame) -> DataFrame:
    """Per text: ``dale_chall, fk_grade, reading_ease``. ``familiar`` has one column ``word`` in lower case.

    The word table is stored, so the planner knows its size: below its threshold it is broadcast and one shuffle by key remains; beyond it
    the words are shuffled, frequent ones as a skewed join.
    """
    words = df.withColumn("counts", text.text_counts(column)).select(
        key, "counts",
        F.explode_outer(text.find_all(F.lower(F.col(column)), text.WORD)).alias("word"),
    )
    known = keep(familiar.select("word").distinct().withColumn("known", F.lit(True)), "words")
    marked = words.withColumn("n", F.lit(1)).join(known, "word", "left")
    unfamiliar = F.sum(F.when(F.col("word").isNotNull() & F.col("known").isNull(), F.col("n")).otherwise(0))
    return (
        marked.groupBy(key).agg(F.first("counts").alias("counts"), unfamiliar.alias("unfamiliar"))
        .select(
            key,
            text.dale_chall(F.col("counts.words"), F.col("unfamiliar"), F.col("counts.sentences")).alias("dale_chall"),
            text.fk_grade(F.col("counts")).alias("fk_grade"),
            text.reading_ease(F.col("counts")).alias("reading_ease"),
        )
    )


def readability_report(df: DataFrame, key: str, column: str, familiar: DataFrame) -> DataFrame:
    names = ["dale_chall", "fk_grade", "reading_ease"]
    return readability(df, key, column, familiar).agg(*[F.avg(c).alias(c) for c in names])


#: bytes of the largest n-gram table that is sent to the tasks: 8 for each n-gram and 8 for each of its languages
MODEL_BYTES = 40 << 20


def gram_keys(texts: Sequence[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping character n-grams (n up to 3) of some texts as numbers, 21 bits to a character, and how many each text has."""
    if not 1 <= n <= 3:
        raise ValueError("n-grams of one to three characters fit a number")
    sizes = np.array([len(t or "") for t in texts], np.int64)
    points = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    if not len(points):
        return points, np.zeros(len(texts), np.int64)
    keys = points[: len(points) - n + 1].copy()
    for k in range(1, n):
        keys = (keys << 21) | points[k : len(points) - n + 1 + k]
    whole = (np.arange(len(points)) + n <= np.repeat(np.cumsum(sizes), sizes))[: len(keys)]
    return keys[whole], np.maximum(sizes - n + 1, 0)


def text_chunks(texts: pa.Array, n: int, limit: int = batches.AT_ONCE) -> Iterator[tuple[np.ndarray, list[str | None]]]:
    """(rows, texts) of slices of a column. A text beyond ``limit`` signs comes in parts that share n - 1 signs, so that each n-gram is in one of them."""
    for start, rows in batches.light(batches.weights(texts), limit):
        part = texts.slice(start, rows).to_pylist()
        if rows > 1 or len(part[0] or "") <= limit:
            yield np.arange(start, start + rows), part
        else:
            for k in range(0, len(part[0]) - n + 1, limit):
                yield np.array([start]), [part[0][k : k + limit + n - 1]]


def add_counts(keys: np.ndarray, counts: np.ndarray, more: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``keys`` and their ``counts`` (a row each) with further ones, which may repeat."""
    if not len(more):
        return keys, counts
    both, rows = np.concatenate([keys, more]), np.concatenate([counts, of])
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    return both[first], np.add.reduceat(rows[order], first, axis=0)


def gram_text(key: int, n: int) -> str:
    return "".join(chr(key >> 21 * k & 0x1FFFFF) for k in range(n - 1, -1, -1))


#: distinct n-grams that a task counts before it hands them on
GRAMS_AT_ONCE = 1 << 18


def fit_lang(df: DataFrame, column: str, lang: str, langs: Sequence[str], n: int = 3) -> DataFrame:
    """Character n-gram counts per language as a table: ``gram, counts array<bigint>`` in the order of ``langs``.

    Every task counts its own n-grams first, a bounded number of signs at a time and up to ``GRAMS_AT_ONCE`` n-grams, so a frequent one is shuffled
    once a task and not once per place."""
    names = [f"n{i}" for i in range(len(langs))]

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64), np.zeros((0, len(langs)), np.int64)

        def made(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            grams = pa.array([gram_text(k, n) for k in keys.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([grams, *(pa.array(c) for c in counts.T)], names=["gram", *names])

        keys, counts = none
        for batch in rows:
            of = np.array(batch.column("l").to_pylist(), object)
            for at, texts in text_chunks(batch.column("t"), n):
                found, sizes = gram_keys(texts, n)
                said = np.repeat(of[at], sizes)
                for i, name in enumerate(langs):
                    more, times = np.unique(found[said == name], return_counts=True)
                    each = np.zeros((len(more), len(langs)), np.int64)
                    each[:, i] = times
                    keys, counts = add_counts(keys, counts, more, each)
                if len(keys) >= GRAMS_AT_ONCE:
                    yield made(keys, counts)
                    keys, counts = none
        if len(keys):
            yield made(keys, counts)

    rows = df.filter(F.col(lang).isin(*langs) & F.col(column).isNotNull()).select(F.lower(column).alias("t"), F.col(lang).alias("l"))
    parts = rows.mapInArrow(count, ", ".join(["gram string", *[f"{c} bigint" for c in names]]))
    return parts.groupBy("gram").agg(F.array(*[F.sum(c) for c in names]).alias("counts"))


def lang_conf(
    df: DataFrame, key: str, column: str, model: DataFrame, langs: Sequence[str], target: str, n: int = 3
) -> DataFrame:
    """Probability of ``target`` among ``langs``: naive Bayes over n-grams with add-one smoothing, equal priors. Keys are unique.

    ``model`` is a stored :func:`fit_lang` table. One of at most ``MODEL_BYTES`` is sent to the tasks and texts are scored in place; the
    n-grams of texts meet a larger one in a shuffle, frequent ones as a skewed join.
    """
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"n{i}") for i in range(len(langs))]
    size = model.agg(F.count(F.lit(1)).alias("grams"), *sums).first()
    if size["grams"] * 8 * (1 + len(langs)) <= MODEL_BYTES:
        return _conf_in_place(df, key, column, model, size, langs.index(target), n)
    per_text = df.select(key, F.explode_outer(text.char_ngrams(F.lower(F.col(column)), n)).alias("gram"))
    per_text = per_text.withColumn("k", F.when(F.col("gram").isNotNull(), 1).otherwise(0))
    logp = [
        F.sum(F.col("k") * F.ln((F.coalesce(F.get("counts", F.lit(i)), F.lit(0)) + 1) / F.lit(float(size[f"n{i}"] + size["grams"])))).alias(f"s{i}")
        for i in range(len(langs))
    ]
    scores = per_text.join(model, "gram", "left").groupBy(key).agg(*logp)
    t = langs.index(target)
    others = [F.exp(F.col(f"s{i}") - F.col(f"s{t}")) for i in range(len(langs))]
    return scores.select(key, (F.lit(1.0) / sum(others[1:], others[0])).alias("confidence"))


def _conf_in_place(df: DataFrame, key: str, column: str, model: DataFrame, size: Row, t: int, n: int) -> DataFrame:
    rows = model.collect()  # at most MODEL_BYTES as numbers
    keys = gram_keys([r["gram"] for r in rows], n)[0]
    order = np.argsort(keys)
    counts = np.array([r["counts"] for r in rows], np.float64).reshape(len(rows), -1)[order]
    total = np.array([(size[f"n{i}"] or 0) + size["grams"] for i in range(len(size) - 1)], np.float64)
    unseen = np.zeros((1, len(total)))
    sent = df.sparkSession.sparkContext.broadcast((keys[order], np.log((np.concatenate([counts, unseen]) + 1) / np.maximum(total, 1))))

    @F.arrow_udf("double")
    def confidence(texts: pa.Array) -> pa.Array:
        known, logs = sent.value
        scores = np.zeros((len(texts), logs.shape[1]))
        for rows, part in text_chunks(texts, n):
            found, sizes = gram_keys(part, n)
            at = np.searchsorted(known, found)
            at[at >= len(known)] = max(len(known) - 1, 0)
            at = np.where(known[at] == found, at, len(known)) if len(known) else np.zeros(len(found), np.int64)
            some = np.flatnonzero(sizes)
            if len(some):
                scores[rows[some]] += np.add.reduceat(logs[at], (np.cumsum(sizes) - sizes)[some], axis=0)
        with np.errstate(over="ignore"):
            return pa.array(1 / np.exp(scores - scores[:, t : t + 1]).sum(1))

    return df.select(key, confidence(F.lower(column)).alias("confidence"))


def grammar_matches(df: DataFrame, key: str, column: str, rules=None) -> DataFrame:
    """One row per match: ``key, rule_id, offset, error_length``. ``rules`` are pairs (name, pattern), of any number; see :func:`automaton.rules_of` for tables."""
    return df.select(key, F.inline(automaton.rule_spans(column, rules or grammar.RULES)))


def mark_spans(df: DataFrame, column: str, good: float = 0.0, bad: float = -1.0, rules=None, out: str = "grammar_rewards"):
    """Adds the token rewards of a text: ``bad`` on the whitespace tokens covered by an error match."""
    return df.withColumn(out, automaton.token_marks(column, rules or grammar.RULES, good, bad))


# The published mteval-v13a tokenization, as (pattern, replacement) in order of use.
BLEU_13A = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    (r"([\{-~\[-` -&\(-\+:-@/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
]


def bleu_tokens(c: Column | str) -> Column:
    c = F.concat(F.lit(" "), col(c), F.lit(" "))
    for pattern, new in BLEU_13A:
        c = F.regexp_replace(c, pattern, new)
    return text.find_all(c, text.NON_SPACE)


def clipped_counts(hyp: list[np.ndarray], ref: list[np.ndarray], max_n: int) -> np.ndarray:
    """Rows x (matches, n-grams of the hypothesis) by order: clipped matches, counted for all rows of a batch at once.

    Tokens are 64-bit hashes. An n-gram of a row is one number mixed from its tokens and the row; sorting puts equal ones side by side, those of
    both sides are counted, and the smaller counts are added up by row."""
    out = np.zeros((len(hyp), 2 * max_n), np.int64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    sides = []
    for rows in (hyp, ref):
        sizes = np.array([len(r) for r in rows], np.int64)
        sides.append((np.concatenate(rows).view(np.uint64) if len(rows) else np.zeros(0, np.uint64), sizes, np.repeat(np.arange(len(rows)), sizes)))
    grams = [np.zeros(len(t), np.uint64) for t, _, _ in sides]
    for n in range(1, max_n + 1):
        keys, owner, side = [], [], []
        for k, (toks, sizes, row) in enumerate(sides):
            size = len(toks)
            whole = np.arange(size) + n <= np.repeat(np.cumsum(sizes), sizes)
            shifted = np.concatenate([toks[n - 1 :], np.zeros(min(n - 1, size), np.uint64)])
            mixed = (grams[k] ^ shifted) * factor
            grams[k] = mixed ^ (mixed >> np.uint64(29))
            keys.append(grams[k][whole])
            owner.append(row[whole])
            side.append(np.full(int(whole.sum()), k))
        out[:, 2 * n - 1] = np.bincount(owner[0], minlength=len(hyp))
        key, row, of = (np.concatenate(x) for x in (keys, owner, side))
        if not len(key):
            continue
        order = np.lexsort((key, row))
        key, row, of = key[order], row[order], of[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1]))))
        in_ref = np.add.reduceat(of, first)
        both = np.minimum(np.diff(first, append=len(key)) - in_ref, in_ref)
        out[:, 2 * n - 2] = np.bincount(row[first], both, len(hyp)).astype(np.int64)
    return out


def corpus_bleu(df: DataFrame, hyp: str, ref: str, max_n: int = 4, smooth: bool = True) -> DataFrame:
    """Corpus BLEU (0–100) with clipped n-gram counts and brevity penalty: one row of counts, precisions and score.

    Tokenization and all sums run in Spark; n-grams are counted for a bounded number of tokens at a time from their hashes, and a task hands on one
    row of sums, so no n-gram is ever shuffled. Counts and lengths come from the same token arrays. ``smooth`` halves the stand-in count for each order in turn
    that has no match (published exponential smoothing).
    """

    orders = range(1, max_n + 1)
    names = [f"c{i}" for i in range(2 * max_n + 1)]

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * max_n + 1, np.int64)
        for batch in parts:
            for start, rows in batches.light(sum(batches.weights(c) for c in batch.columns)):
                sides = [c.slice(start, rows) for c in batch.columns]
                sizes = [batches.weights(c) for c in sides]
                flat = [np.split(c.flatten().to_numpy(), np.cumsum(z)[:-1]) for c, z in zip(sides, sizes, strict=True)]
                sums[:-1] += clipped_counts(*flat, max_n).sum(0)
                sums[-1] += sizes[1].sum()
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums.tolist()], names=names)

    # a row with a null side counts nothing
    hashed = lambda c: F.transform(bleu_tokens(c), lambda t: F.xxhash64(t))
    lines = df.filter(F.col(hyp).isNotNull() & F.col(ref).isNotNull()).select(hashed(hyp).alias("h"), hashed(ref).alias("r"))
    rows = lines.mapInArrow(counted, ", ".join(f"{c} bigint" for c in names))

    def added(i: int, name: str) -> Column:
        return F.coalesce(F.sum(names[i]), F.lit(0)).alias(name)

    total = rows.agg(
        *[added(2 * n - 2, f"match{n}") for n in orders],
        *[added(2 * n - 1, f"total{n}") for n in orders],
        added(2 * max_n, "ref_len"),
    )
    misses = F.lit(0)
    logs = []
    for n in orders:
        misses = misses + F.when(F.col(f"match{n}") == 0, 1).otherwise(0)
        smoothed = F.when(F.lit(smooth), F.lit(1.0) / F.pow(F.lit(2.0), misses)).otherwise(F.lit(0.0))
        p = F.when(F.col(f"match{n}") > 0, F.col(f"match{n}").cast("double")).otherwise(smoothed) / F.col(f"total{n}")
        logs.append(F.ln(p))
    brevity = F.when(F.col("total1") >= F.col("ref_len"), F.lit(1.0)).otherwise(
        F.exp(F.lit(1.0) - F.col("ref_len") / F.col("total1"))
    )
    mean_log = sum(logs[1:], logs[0]) / max_n
    return total.withColumn("brevity_penalty", brevity).withColumn(
        "bleu", F.coalesce(F.exp(mean_log) * F.col("brevity_penalty") * 100, F.lit(0.0))
    )


# The tags of a judge template; every message stands between a start tag and the end tag.
START_TAGS = {"system": "<|im_start|>system\n", "user": "<|im_start|>user\n"}
END_TAG = "\n<|im_end|>"

DEFAULT_JUDGE_TEMPLATE = (
    START_TAGS["system"] + "You compare two answers to one instruction and name the better one." + END_TAG + "\n"
    + START_TAGS["user"]
    + "Name the answer that fits the instruction best: reply with Output (a) or Output (b) only.\n\n"
    + "## Instruction:\n{instruction}\n\n## Output (a):\n{output_1}\n\n## Output (b):\n{output_2}\n\n"
    + "## Best:" + END_TAG
)


def judge_conversation(template: Column, instruction: Column, first: Column, second: Column) -> Column:
    """``array<struct<role, content>>`` with the template's system text and its filled user text."""
    part = {role: F.get(text.between_tags(template, tag, END_TAG), F.lit(0)) for role, tag in START_TAGS.items()}
    user = text.fill_template(part["user"], {"instruction": instruction, "output_1": first, "output_2": second})
    return F.array(
        F.struct(F.lit("system").alias("role"), part["system"].alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")),
    )
