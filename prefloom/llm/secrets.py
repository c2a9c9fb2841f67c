"""Secret scans: fixed patterns, and a battery of randomness tests on the remaining long tokens.

Fixed patterns give the kinds ``assign``, ``access`` and ``hex``. The battery looks at what they leave of every maximal run of key
characters, cut at "=" (so the value of NAME=value is a token; padding is no part of one), that holds letters and digits. A token that fits no
alphabet is cut at "+/" or at "-_" into the longest parts that do. The smallest alphabet that holds all its characters is its encoding, and three
tests ask whether it could be a uniform draw from that alphabet: chi-squared of the character counts, the runs test above
and below the middle of the alphabet, and the serial correlation of neighbours. Fisher's sum joins the three p-values.

Random tokens have even p-values, while for words, paths and numbers they pile up near 0, the more so the longer the
token. So within a stratum (encoding and length band) the even part is read off the upper half of the p-values and all
above it is taken as false; a token counts as a secret when its p-value is at or above the lowest bound at which the
false share stays within ``fdr``. Counts by stratum and p-value cover all rows, and their number is fixed by
encodings x bands x bins, so they are gathered on the driver.

Null texts count as empty; empty texts have no spans. Repeated rows are scanned each for itself. All columns of the
input are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefloom.llm.common import map_batches, spare, text_of

# Kinds and patterns of the base spans, (kind, pattern, length that must be reached, group it is asked of)
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
)
KINDS = tuple(b[0] for b in BASE) + ("random",)

#: alphabets from small to large; "+/" and "-_" both stand for the last two signs of base 64
ALPHABETS = (
    ("hex_upper", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
BANDS = (20, 24, 32, 48, 64, 96)
BINS = 50


@dataclass(frozen=True)
class Battery:
    """``min_len`` and ``fdr`` are the parameters of the battery; ``p_floor`` is the p-value below which no token
    passes, whatever its stratum holds."""

    min_len: int = 20
    fdr: float = 0.02
    p_floor: float = 0.001


_ASSIGN, _ACCESS = (re.compile(b[1], re.ASCII) for b in BASE[:2])
_LONG_HEX = re.compile(r"[0-9a-f]{16,}", re.ASCII)  # the maximal runs of [0-9a-f]+ that are long enough
_WORDS = ("passw", "secret", "token", "api")
_CODES = [{c: k for k, c in enumerate(a)} for _, a in ALPHABETS]
_SETS = [frozenset(a) for _, a in ALPHABETS]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base spans, by start and then by kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):  # each keyword holds one of these
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _LONG_HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def _upper_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * df)
    return _upper_tail(((x / df) ** (1 / 3) - (1 - v)) / math.sqrt(v))


def infer_alphabet(token: str) -> int | None:
    chars = set(token)
    return next((k for k, s in enumerate(_SETS) if chars <= s), None)


def battery_p(token: str, alphabet: int) -> float:
    """Joint p-value (Fisher) of the three tests that the token is an even, independent draw from the alphabet."""
    codes = np.array([_CODES[alphabet][c] for c in token], dtype=np.float64)
    n, size = len(codes), len(ALPHABETS[alphabet][1])
    counts = np.bincount(codes.astype(np.int64), minlength=size)
    chi = float(((counts - n / size) ** 2).sum() * size / n)
    p_even = _chi2_tail(chi, size - 1)
    high = codes >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * n0 * n1 / n
        var = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * _upper_tail(abs(runs - mean) / math.sqrt(var))
    else:
        p_runs = 2.0 ** (1 - n)
    centred = codes - codes.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    p_serial = 2 * _upper_tail(abs(serial + 1 / n) * math.sqrt(n))
    fisher = -2 * sum(math.log(max(min(p, 1.0), 1e-300)) for p in (p_even, p_runs, p_serial))
    half = fisher / 2  # the tail of chi-squared with 6 degrees of freedom in closed form
    return math.exp(-half) * (1 + half + half * half / 2)


# a sign of equality ends a token; behind the last one it is padding, which counts for the length
_PART = re.compile(r"([A-Za-z0-9+/_-]+)(?:=+(?![A-Za-z0-9+/_=-]))?", re.ASCII)
_NO_SLASH, _NO_DASH = re.compile(r"[^+/]+"), re.compile(r"[^_-]+")


def candidates(text: str, base: Sequence[tuple[int, int, int]], run: re.Pattern, least: int) -> list[tuple[int, int, int, float]]:
    """(start, end, stratum, p) of the tested tokens: what base spans leave of the runs, cut at "="."""
    out = []
    at = 0  # base spans before this one end before the run
    for m in run.finditer(text):
        start, stop = m.span()
        while at < len(base) and base[at][1] <= start:
            at += 1
        free, k = start, at
        rests = []
        while k < len(base) and base[k][0] < stop:
            rests.append((free, base[k][0]))
            free = max(free, base[k][1])
            k += 1
        rests.append((free, stop))
        for s, e in rests:
            if e - s < least:
                continue
            for part in _PART.finditer(text, s, e):
                if part.end() - part.start() >= least:
                    out += tested(text, *part.span(1), least)
    return out


def tested(text: str, start: int, end: int, least: int) -> Iterator[tuple[int, int, int, float]]:
    """The token as a whole, or when no alphabet holds it, its longest parts that one does."""
    token = text[start:end]
    if token.isalpha() or token.isdigit() or not any(c.isdigit() for c in token):
        return
    alphabet = infer_alphabet(token)
    if alphabet is not None:
        band = sum(len(token) >= b for b in BANDS)
        yield start, end, alphabet * (len(BANDS) + 1) + band, battery_p(token, alphabet)
        return
    # both kinds of joining signs occur: parts between those of one kind fit the alphabet with the other
    parts = [(start + m.start(), start + m.end()) for p in (_NO_SLASH, _NO_DASH) for m in p.finditer(token) if m.end() - m.start() >= least]
    taken: list[tuple[int, int]] = []
    for s, e in sorted(parts, key=lambda x: (x[0] - x[1], x[0])):
        k = bisect(taken, (s, e))
        if (not k or taken[k - 1][1] <= s) and (k == len(taken) or e <= taken[k][0]):
            taken.insert(k, (s, e))
    for s, e in taken:
        yield from tested(text, s, e, least)


def _pattern(battery: Battery) -> re.Pattern:
    return re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % battery.min_len, re.ASCII)


def fit_bounds(df: DataFrame, text: str = "text", battery: Battery = Battery()) -> dict[int, float]:
    """Lowest p-value that counts as random, by stratum; strata without an acceptable bound are left out."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        run = _pattern(battery)
        tally: dict[tuple[int, int], int] = {}
        for t in text_of(batch, text):
            for _, _, stratum, p in candidates(t, base_spans(t), run, battery.min_len):
                at = (stratum, min(int(p * BINS), BINS - 1))
                tally[at] = tally.get(at, 0) + 1
        if not tally:
            return None
        return pa.RecordBatch.from_pydict(
            {
                "stratum": pa.array([k[0] for k in tally], pa.int32()),
                "bin": pa.array([k[1] for k in tally], pa.int32()),
                "n": pa.array(list(tally.values()), pa.int64()),
            }
        )

    # at most strata x BINS rows reach the driver
    rows = map_batches(df.select(text), count, "stratum int, bin int, n bigint").groupBy("stratum", "bin").agg(F.sum("n").alias("n")).collect()
    counts: dict[int, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r["stratum"], np.zeros(BINS))[r["bin"]] = r["n"]
    bounds = {}
    for stratum, by_bin in counts.items():
        even = by_bin[BINS // 2 :].mean()
        total = by_bin[::-1].cumsum()[::-1]
        expected = even * np.arange(BINS, 0, -1)
        false_share = np.maximum(total - expected, 0) / np.maximum(total, 1)
        # a random deviation of an even count is no evidence of false ones
        slack = 2 * np.sqrt(np.maximum(expected, 1)) / np.maximum(total, 1)
        good = np.flatnonzero((false_share <= battery.fdr + slack) & (total > 0))
        if len(good):
            bounds[stratum] = max(float(good[0]) / BINS, battery.p_floor)
    return bounds


def find_secrets(df: DataFrame, text: str = "text", battery: Battery = Battery(), redact: bool = False) -> DataFrame:
    """All rows and columns of ``df`` with ``spans array<struct<kind, start, end>>`` (code points, end exclusive), by
    start and then by kind; a taken name gets an underscore in front. With ``redact`` the text is rewritten instead: overlapping spans are joined and each is
    replaced by a mark that names the first kind; a null text stays null."""
    bounds = fit_bounds(df, text, battery)
    name = spare(df, "spans")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = df.schema if redact else T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(span))])

    def spans_of(t: str, run: re.Pattern) -> list[tuple[int, int, int]]:
        base = base_spans(t)
        more = [(s, e, 3) for s, e, stratum, p in candidates(t, base, run, battery.min_len) if stratum in bounds and p >= bounds[stratum]]
        return sorted([*base, *more], key=lambda s: (s[0], s[2])) if more else base

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        run = _pattern(battery)
        if not redact:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans_of(t, run)] for t in text_of(batch, text)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])
        clean = [t if t is None else hide(t, spans_of(t, run)) for t in batch.column(text).to_pylist()]
        at = batch.schema.names.index(text)
        columns = [pa.array(clean, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return map_batches(df, work, schema)


def hide(text: str, spans: Sequence[tuple[int, int, int]]) -> str:
    out, at = [], 0
    joined: list[list[int]] = []
    for s, e, k in spans:
        if joined and s < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e, k])
    for s, e, k in joined:
        out += [text[at:s], f"<{KINDS[k]}>"]
        at = e
    return "".join([*out, text[at:]])


def digest(df: DataFrame, key: str = "doc_id", text: str = "text", battery: Battery = Battery()) -> DataFrame:
    """One row per input row: counts of the base kinds, the hash of the base spans and the list of all spans."""
    found = find_secrets(df.select(key, text), text, battery).drop(text)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        key,
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )

