"""Error rules of any number, matched in one pass over each text.

A rule is a name and a pattern in the syntax that Java, RE2 and Python share (ASCII classes). From each pattern the texts are worked out one of which
every match must hold: a literal, or the members of a small set. All of them go into one Aho–Corasick automaton (single signs into a table), which
is walked once along a text; only the rules that are hit this way, and the few that have no such text, are then matched. A rule whose matches all
begin with its literal is matched only where the literal stands, not along the whole text. So the time does not grow with the rules that do not hit,
and little with those whose literal is there but which do not match. Texts are worked on a bounded number of bytes at a time. Spans are joined to tokens by a sweep over the sorted ends of the tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.functions import batches
from prefloom.functions.common import col

Rules = Sequence[tuple[str, str]]
SPANS = "array<struct<rule_id: string, offset: int, error_length: int>>"
#: members of a set up to which it is told apart by its members
SET = 16
#: bytes of names and patterns that a table of rules may have, as it is sent to every task
RULE_BYTES = 32 << 20
_WORD = re.compile(r"\S+", re.ASCII)


def factors(pattern: str) -> set[str] | None:
    """Texts one of which each match of ``pattern`` holds, as long as can be told; None where none can."""
    from re import _parser

    parsed = _parser.parse(pattern, re.ASCII)
    return None if parsed.state.flags & re.IGNORECASE else _factors(list(parsed))


def _factors(parts: list) -> set[str] | None:
    from re import _constants as c

    found: list[set[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            found.append({run})
        run = ""

    for op, value in parts:
        if op is c.LITERAL:
            run += chr(value)
        elif op is c.AT:
            continue  # takes no signs, so the literal goes on
        elif op is c.SUBPATTERN and not value[1] & re.IGNORECASE and all(o is c.LITERAL for o, _ in value[3]):
            run += "".join(chr(v) for _, v in value[3])
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, sub = value
            if all(o is c.LITERAL for o, _ in sub):
                run += "".join(chr(v) for _, v in sub) * min(low, 32)
                if low != high or low > 32:
                    close()
            else:
                close()
                if low and (inner := _factors(list(sub))):
                    found.append(inner)
        else:
            close()
            inner = None
            if op is c.SUBPATTERN and not value[1] & re.IGNORECASE:
                inner = _factors(list(value[3]))
            elif op is c.BRANCH:
                ways = [_factors(list(way)) for way in value[1]]
                inner = set().union(*ways) if all(ways) else None
            elif op is c.IN and len(value) <= SET and all(o is c.LITERAL for o, _ in value):
                inner = {chr(v) for _, v in value}
            if inner:
                found.append(inner)
    close()
    return max(found, key=lambda f: (min(map(len, f)), -len(f)), default=None)


def head(pattern: str) -> str:
    """The literal that each match of ``pattern`` begins with, as far as it can be told."""
    from re import _constants as c, _parser

    parsed = _parser.parse(pattern, re.ASCII)
    run = ""
    for op, value in () if parsed.state.flags & re.IGNORECASE else parsed:
        if op is c.LITERAL:
            run += chr(value)
        elif op is c.AT:
            continue
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and all(o is c.LITERAL for o, _ in value[2]):
            run += "".join(chr(v) for _, v in value[2]) * min(value[0], 32)
            if value[0] != value[1] or value[0] > 32:
                break
        else:
            break
    return run


class RuleSet:
    """Compiled rules."""

    def __init__(self, rules: Rules) -> None:
        self.names = [name for name, _ in rules]
        self.patterns = [re.compile(pattern, re.ASCII) for _, pattern in rules]
        self.at = [p.match for p in self.patterns]
        self.always: list[int] = []
        self.signs: dict[str, list[int]] = {}
        texts: dict[str, tuple[list[int], list[int]]] = {}
        for k, (_, pattern) in enumerate(rules):
            held = factors(pattern)
            if held is None:
                self.always.append(k)
            for f in held or ():
                if len(f) == 1:
                    self.signs.setdefault(f, []).append(k)
                else:
                    texts.setdefault(f, ([], []))[head(pattern).startswith(f)].append(k)
        #: of each text the rules that hold it somewhere, and those that begin with it
        self.of = list(texts.values())
        self.sizes = [len(f) for f in texts]
        self.automaton = ahocorasick.Automaton()
        for k, f in enumerate(texts):
            self.automaton.add_word(f, k)
        if texts:
            self.automaton.make_automaton()

    def hit(self, text: str) -> tuple[list[int], list[tuple[int, list[int]]]]:
        """Rules that may match somewhere, and (rule, places) of those that may match at these places only."""
        rules = set(self.always)
        placed: list[tuple[int, list[int]]] = []
        if self.signs:
            for sign in self.signs.keys() & set(text):
                rules.update(self.signs[sign])
        if self.of:
            ends: dict[int, list[int]] = {}
            for end, k in self.automaton.iter(text):
                ends.setdefault(k, []).append(end)
            for k, found in ends.items():
                anywhere, begin = self.of[k]
                rules.update(anywhere)
                if begin:
                    starts = [end + 1 - self.sizes[k] for end in found]
                    placed.extend((rule, starts) for rule in begin)
        return sorted(rules), placed

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(rule, offset, length) by rule and offset."""
        rules, placed = self.hit(text)
        found = [(k, m.start(), m.end() - m.start()) for k in rules for m in self.patterns[k].finditer(text)]
        for k, starts in placed:
            match, behind = self.at[k], 0
            for at in starts:
                # leftmost matches that do not overlap, as in a search along the text
                if at >= behind and (m := match(text, at)):
                    behind = m.end()
                    found.append((k, at, behind - at))
        return sorted(found) if placed else found


@lru_cache(maxsize=4)
def rule_set(rules: tuple[tuple[str, str], ...]) -> RuleSet:
    return RuleSet(rules)


def rules_of(table: DataFrame, name: str = "rule_id", pattern: str = "pattern") -> list[tuple[str, str]]:
    """The rules of a table in the order of their names. Its size is checked first, as every task gets all of them."""
    rows = table.select(F.col(name).alias("n"), F.col(pattern).alias("p")).filter("n is not null and p is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("n") + F.octet_length("p"))).first()[0] or 0
    if size > RULE_BYTES:
        raise ValueError(f"rules have {size} bytes, more than {RULE_BYTES}")
    return sorted((r["n"], r["p"]) for r in rows.collect())


def rule_spans(c: Column | str, rules: Rules) -> Column:
    """``[{rule_id, offset, error_length}]`` of all rules, by rule and offset; null for a null text."""
    fixed = tuple(map(tuple, rules))

    @F.arrow_udf(SPANS)
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = rule_set(fixed)
        for texts in light(parts):
            sizes, rule, offset, length = [], [], [], []
            for text in texts.to_pylist():
                found = compiled.matches(text) if text is not None else ()
                sizes.append(len(found))
                for k, at, n in found:
                    rule.append(k)
                    offset.append(at)
                    length.append(n)
            names = pa.array(compiled.names, pa.string()).take(pa.array(rule, pa.int64()))
            items = pa.StructArray.from_arrays([names, pa.array(offset, pa.int32()), pa.array(length, pa.int32())], names=["rule_id", "offset", "error_length"])
            ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), items, mask=texts.is_null())

    return spans(col(c))


def light(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts in slices of bounded size; a batch without rows gives one without rows."""
    for texts in parts:
        if not len(texts):
            yield texts
        for start, rows in batches.light(batches.weights(texts)):
            yield texts.slice(start, rows)


def mark_text(text: str, compiled: RuleSet) -> np.ndarray:
    """Which white-space tokens of a text are covered by error spans. A span begins at the first token that ends at or behind its offset and
    takes further tokens while the text from that token on is no longer than the span; one behind the last token is left out."""
    words = [w.span() for w in _WORD.finditer(text)]
    marks = np.zeros(len(words) + 1, np.int64)
    found = compiled.matches(text) if words else []
    if found:
        starts, ends = np.array(words).T
        _, offset, size = np.array(found).T
        first = np.searchsorted(ends, offset, side="left")
        inside = first < len(words)
        first, size = first[inside], size[inside]
        behind = np.searchsorted(ends, starts[first] + size, side="right")
        some = behind > first
        np.add.at(marks, first[some], 1)
        np.add.at(marks, behind[some], -1)
    return np.cumsum(marks[:-1]) > 0


def token_marks(c: Column | str, rules: Rules, good: float, bad: float) -> Column:
    """Rewards of the white-space tokens of a text: ``bad`` on those that error spans cover, ``good`` elsewhere."""
    fixed = tuple(map(tuple, rules))

    @F.arrow_udf("array<double>")
    def marked(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        compiled = rule_set(fixed)
        for texts in light(columns):
            parts = [mark_text(t or "", compiled) for t in texts.to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, bool)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.where(flat, bad, good)), mask=texts.is_null())

    return marked(col(c))
