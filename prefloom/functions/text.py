"""Text measures as column expressions. All of them see the whole text."""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.common import col, let, prefix_sums, ratio, scan

# The default patterns. They use only syntax that Java and RE2 regexes share.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
WORD = r"[\p{L}\p{N}']+"
SENTENCE = r"[^.!?]+[.!?]*\s*|[.!?]+\s*"
NON_SPACE = r"\S+"
WORD_RUN = r"\s*(?:\S+\s*){1,64}"
VOWELS = r"[aeiouyàáâäãåæèéêëìíîïòóôöõøùúûüœ]+"


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens(c: Column | str, pattern: str = TOKEN) -> Column:
    return find_all(col(c), pattern)


def token_count(c: Column | str, pattern: str = TOKEN) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def token_ids(toks: Column, vocab: int = 50_000, first: int = 10) -> Column:
    """Hashed ids ``first .. first+vocab-1``; smaller ids stay free for special tokens."""
    return F.transform(
        toks,
        lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % vocab + first).cast("int"),
    )


def token_id(token: str, vocab: int = 50_000, first: int = 10) -> int:
    """The id :func:`token_ids` gives to one token."""
    return int(md5(token.encode()).hexdigest()[:8], 16) % vocab + first


def sentence_pieces(c: Column | str) -> Column:
    return find_all(col(c), SENTENCE)


def sentence_spans(c: Column | str) -> Column:
    """``[{start, end, text}]`` of the sentences, in characters; blank pieces are dropped."""
    return piece_spans(sentence_pieces(c))


def piece_spans(pieces: Column) -> Column:
    """Character spans of pieces that together make up the text; blank ones are dropped."""

    def spans(ps: Column) -> Column:
        ends = prefix_sums(F.transform(ps, lambda p: F.length(p)))
        return F.zip_with(ps, ends, lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end"), p.alias("text")))

    return F.filter(let(pieces, spans), lambda s: F.regexp_replace(s["text"], r"\s+", "") != "")


def sentence_ends(c: Column | str) -> Column:
    """``[0, end, end, …]`` in characters."""
    return F.concat(F.array(F.lit(0)), F.transform(sentence_spans(c), lambda s: s["end"]))


def slices(text: Column, cuts: Column) -> Column:
    """``[{start, end, text}]`` for each pair of neighbouring cut offsets."""
    n = F.greatest(F.size(cuts) - 1, F.lit(0))
    return F.zip_with(
        F.slice(cuts, 1, n),
        F.slice(cuts, 2, n),
        lambda a, b: F.struct(
            a.alias("start"), b.alias("end"), F.substring(text, a + 1, b - a).alias("text")
        ),
    )


def tokens_with_offsets(c: Column | str, few: bool = False) -> Column:
    """``[{token, start}]`` of the whitespace tokens; the gaps between them come from splitting on the tokens. ``few`` says that there are few enough
    for one fold."""
    ends_of = (lambda lengths: scan(lengths, F.lit(0), lambda s, n: s + n, "int")) if few else prefix_sums
    c = col(c)

    def spans(toks: Column) -> Column:
        gaps = F.slice(F.split(c, NON_SPACE, -1), 1, F.size(toks))
        ends = ends_of(F.zip_with(gaps, toks, lambda g, t: F.length(g) + F.length(t)))
        return F.zip_with(toks, ends, lambda t, e: F.struct(t.alias("token"), (e - F.length(t)).alias("start")))

    return let(find_all(c, NON_SPACE), spans)


def piece_starts(toks: Column, min_words: int = 5) -> Column:
    """Zero-based word positions where a sub-sentence starts, given the words of one sentence.

    A word after a trailing ``, ; ! ?`` may open a piece when more than ``min_words`` words are left from it on.
    When the running piece is still short, its own start is given up in favour of the new one, except that the
    first piece of the sentence keeps its start and takes no break.
    """
    return let(toks, lambda words: _piece_starts(words, min_words))


def _piece_starts(toks: Column, min_words: int) -> Column:
    opens = F.filter(
        F.when(F.size(toks) > 1, F.sequence(F.lit(1), F.size(toks) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.element_at(toks, i).rlike(r"[,;!?]$") & (i + min_words < F.size(toks)),
    )
    return F.aggregate(
        opens,
        F.array(F.lit(0)),
        lambda starts, i: let(
            F.element_at(starts, -1),
            lambda last: F.when(i - last >= min_words, F.concat(starts, F.array(i)))
            .when(last > 0, F.concat(F.slice(starts, 1, F.size(starts) - 1), F.array(i)))
            .otherwise(starts),
        ),
    )


def subsentence_cuts(c: Column | str, min_words: int = 5) -> Column:
    """Character offsets where sub-sentences start, closed by the text length."""
    c = col(c)
    per_sentence = F.transform(
        sentence_spans(c),
        lambda s: let(
            tokens_with_offsets(s["text"]),
            lambda toks: F.transform(
                piece_starts(F.transform(toks, lambda t: t["token"]), min_words),
                lambda i: s["start"] + F.get(toks, i)["start"],
            ),
        ),
    )
    return F.concat(F.flatten(per_sentence), F.array(F.length(c)))


def word_spans(c: Column | str) -> Column:
    """``[{token, start, end}]`` of all whitespace tokens of the text, worked out in runs of up to 64 tokens."""
    return F.flatten(
        F.transform(
            piece_spans(find_all(col(c), WORD_RUN)),
            lambda s: F.transform(
                tokens_with_offsets(s["text"], few=True),
                lambda t: F.struct(
                    t["token"].alias("token"),
                    (s["start"] + t["start"]).alias("start"),
                    (s["start"] + t["start"] + F.length(t["token"])).alias("end"),
                ),
            ),
        )
    )


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(WORD))


def sentence_count(c: Column | str) -> Column:
    return F.greatest(F.regexp_count(col(c), F.lit(r"[^.!?\s][^.!?]*")), F.lit(1))


def syllable_count(c: Column | str) -> Column:
    """Runs of vowels, and at least one syllable for each word without a vowel."""
    low = F.lower(col(c))
    return F.regexp_count(low, F.lit(VOWELS)) + F.aggregate(
        find_all(low, WORD), F.lit(0), lambda n, w: n + F.when(F.regexp_count(w, F.lit(VOWELS)) == 0, 1).otherwise(0)
    )


def text_counts(c: Column | str) -> Column:
    return F.struct(
        word_count(c).cast("double").alias("words"),
        sentence_count(c).cast("double").alias("sentences"),
        syllable_count(c).cast("double").alias("syllables"),
    )


def fk_grade(counts: Column) -> Column:
    """Flesch–Kincaid grade of a :func:`text_counts` struct; 0 for a text without words."""
    w, s, y = counts["words"], counts["sentences"], counts["syllables"]
    return F.coalesce(F.lit(0.39) * (w / s) + F.lit(11.8) * F.try_divide(y, w) - F.lit(15.59), F.lit(0.0))


def reading_ease(counts: Column) -> Column:
    """Flesch reading ease of a :func:`text_counts` struct; 0 for a text without words."""
    w, s, y = counts["words"], counts["sentences"], counts["syllables"]
    return F.coalesce(F.lit(206.835) - F.lit(1.015) * (w / s) - F.lit(84.6) * F.try_divide(y, w), F.lit(0.0))


def dale_chall(words: Column, unfamiliar: Column, sentences: Column) -> Column:
    """Published Dale–Chall score; the adjustment applies above 5 % unfamiliar words."""
    share = ratio(unfamiliar * 100, words)
    raw = F.lit(0.1579) * share + F.lit(0.0496) * ratio(words, sentences)
    return F.coalesce(F.when(share > 5, raw + F.lit(3.6365)).otherwise(raw), F.lit(0.0))


def between_tags(c: Column | str, start: str, end: str) -> Column:
    """All texts between two literal tags, also across lines."""
    return find_all(col(c), rf"(?s)\Q{start}\E(.*?)\Q{end}\E", 1)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by each value in turn; text put in earlier is searched again for later names."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def verdict(c: Column | str) -> Column:
    """1 when the answer names output (a), else 0 when it names output (b), else null."""
    low = F.lower(col(c))
    return F.when(low.contains("output (a)"), 1).when(low.contains("output (b)"), 0)


# The two request URL forms; the first group is the endpoint.
ENDPOINT_URLS = [
    r"^https://[^/]+/v\d+/(.+)$",
    r"^https://[^/]+/openai/deployments/[^/]+/(.+?)(\?|$)",
]


def endpoint(c: Column | str, patterns: list[str] | None = None) -> Column:
    """First URL pattern that matches gives the endpoint; null when none does."""
    found = [F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")) for p in patterns or ENDPOINT_URLS]
    return F.coalesce(*found)


def collapse_spaces(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """All overlapping character n-grams, found as n interleaved series of non-overlapping ones (linear time)."""
    shifted = [find_all(F.substring(c, k + 1, 2**31 - 1) if k else c, rf"(?s).{{{n}}}") for k in range(n)]
    return F.concat(*shifted)
