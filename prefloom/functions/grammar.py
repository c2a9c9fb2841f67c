"""Rule-based error matches inside a text: no join, one expression per rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.common import col, let, prefix_sums

# The default rules (name, pattern). Patterns use only syntax that Java and RE2 regexes share.
RULES = [
    ("double_space", r"  +"),
    ("space_before_punctuation", r" +[,.;:!?]"),
    ("repeated_punctuation", r"[,;:!?]{2,}"),
    ("lower_case_i", r"\bi\b"),
    ("missing_space", r"[,;][A-Za-z]"),
    ("lower_case_start", r"[.!?] +[a-z]"),
]


def rule_matches(c: Column | str, rule_id: str, pattern: str) -> Column:
    """``[{rule_id, offset, error_length}]`` of one rule; offsets add up the texts between the matches."""
    c = col(c)

    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(c, pattern, -1), 1, F.size(found))
        ends = prefix_sums(F.zip_with(gaps, found, lambda g, h: F.length(g) + F.length(h)))
        return F.zip_with(
            found, ends,
            lambda h, e: F.struct(F.lit(rule_id).alias("rule_id"), (e - F.length(h)).alias("offset"), F.length(h).alias("error_length")),
        )

    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), spans)


def matches(c: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    return F.concat(*[rule_matches(c, name, pattern) for name, pattern in rules or RULES])


def match_count(c: Column | str, rules: list[tuple[str, str]] | None = None) -> Column:
    """Number of matches, without locating them."""
    counts = [F.regexp_count(col(c), F.lit(pattern)) for _, pattern in rules or RULES]
    total = counts[0]
    for n in counts[1:]:
        total = total + n
    return total
