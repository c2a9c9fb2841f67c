"""Token counts without tokens: best unigram segmentation by Aho-Corasick and a count-only Viterbi.

The vocabulary with its scores comes from a public piece model. An Aho-Corasick automaton lists all pieces that end at
each place of a text, longest first; the dynamic programme keeps, for each place, the best score of a
segmentation up to there and its number of pieces, nothing else. Ties are the tokenizer's: a later candidate replaces an
earlier one only with a higher score, and candidates for one end come in order of their starts. A character that is no piece
of its own may be unknown at the lowest score less 10; it then counts one piece for each of its bytes (byte fallback).

Texts are written with a mark in front and for each space. No piece holds a mark behind another sign, so each
best segmentation ends a piece before such a mark, and texts are counted in stretches from mark to mark, as well as around signs that no
piece holds. Counts of stretches are remembered in a table of bounded size; that changes the time only.

Cases: a null text counts as empty and has no tokens; very long texts and very long stretches are read in one pass; repeated
rows are counted each for itself; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prefloom.llm.common import map_batches, text_of

MARK = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def pieces_of(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of the ordinary pieces of a model file with byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    if sum(map(model.is_byte, every)) != 256:
        raise ValueError("the vocabulary needs a piece for each byte")
    odd = lambda k: model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k)
    return tuple((model.id_to_piece(k), model.get_score(k)) for k in every if not odd(k))


class Counter:
    """Counts the pieces of texts for one vocabulary."""

    def __init__(self, vocabulary: tuple[tuple[str, float], ...]) -> None:
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        used = {c for p, _ in vocabulary for c in p}
        apart = "".join(c for c in "\n\t\r" if c not in used)
        marks_lead = MARK in used and not any(MARK in p.lstrip(MARK) for p, _ in vocabulary)
        cut = f"[{apart}]" if apart else None
        body = rf"[^{MARK}{apart}]"
        if marks_lead:
            self.stretches = re.compile(rf"{MARK}*{body}+|{MARK}+" + (f"|{cut}" if cut else ""))
        else:
            self.stretches = re.compile(rf"[^{apart}]+|{cut}" if cut else r"(?s:.+)")
        self.known: dict[str, int] = {}

    def viterbi(self, text: str) -> int:
        n = len(text)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        matches = self.automaton.iter(text)
        at, hit = next(matches, (n, None))
        single, unknown = self.single, self.unknown
        for end in range(1, n + 1):
            top, pieces = None, 0
            while at == end - 1:
                size, score = hit
                score += best[end - size]
                if top is None or score > top:
                    top, pieces = score, count[end - size] + 1
                at, hit = next(matches, (n, None))
            sign = text[end - 1]
            if sign not in single:
                score = best[end - 1] + unknown
                if top is None or score > top:
                    top, pieces = score, count[end - 1] + len(sign.encode("utf-8", "surrogatepass"))
            best[end], count[end] = top, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        known, total = self.known, 0
        for stretch in self.stretches.findall(MARK + text.replace(" ", MARK)):
            n = known.get(stretch)
            if n is None:
                n = self.viterbi(stretch)
                if len(stretch) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[stretch] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(pieces_of(path))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_chars, n_tokens`` for every row."""
    path = path or model_path()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        count, texts = counter(path).count, text_of(batch, text)
        columns = [batch.column(key), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.array([count(t) for t in texts], np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=[key, "n_chars", "n_tokens"])

    return map_batches(df.select(key, text), work, f"`{key}` {df.schema[key].dataType.simpleString()}, n_chars bigint, n_tokens bigint")
