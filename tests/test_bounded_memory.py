"""Workers hold a bounded part of an Arrow batch, and parts of an ordering a bounded number of bytes."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefloom.functions import automaton, batches, grammar
from prefloom.operators import models, ordering, textops

MB = 1 << 20


@pytest.fixture
def given(spark, monkeypatch):
    """The functions that are handed to Spark."""
    found = []
    kind = type(spark.range(1))
    run = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, fn, *a: found.append(fn) or run(df, fn, *a))
    udf = F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda kind: lambda fn: found.append(fn) or udf(kind)(fn))
    return found


def peak(work):
    tracemalloc.start()
    out = work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_slices_are_light():
    assert [*batches.light(np.array([3, 3, 3, 9, 0, 1, 1]), 6)] == [(0, 2), (2, 1), (3, 1), (4, 3)]
    assert batches.weights(pa.array(["é", None, ""])).tolist() == [2, 0, 0] and batches.weights(pa.array([[1, 2], None])).tolist() == [2, 0]


def letters(n, rows=40):
    rng = random.Random(3)
    return ["".join(rng.choices("abcd ", k=n // rows)) for _ in range(rows)]


def test_languages_are_fitted_a_slice_at_a_time(spark, given):
    texts = [*letters(4 * MB), "".join(letters(MB))]
    schema = spark.createDataFrame([("a", "en")], "t string, lang string")
    textops.fit_lang(schema, "t", "lang", ["en", "de"])
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["en", "de"] * 20 + ["de"])], names=["t", "l"])
    out, most = peak(lambda: [*given[-1](iter([batch]))])
    assert most < 100 * MB
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["n0"] + r["n1"] for r in rows) == sum(len(t) - 2 for t in texts)
    assert {r["gram"]: r["n1"] for r in rows}["abc"] == sum(t.count("abc") for t in [*texts[1::2], texts[-1]])


def test_languages_are_scored_a_slice_at_a_time(spark, given):
    docs = spark.createDataFrame([(1, "aab"), (2, None), (3, "b")], "k int, t string")
    model = textops.fit_lang(spark.createDataFrame([("aaba", "en"), ("abbb", "de")], "t string, lang string"), "t", "lang", ["en", "de"])
    got = dict(textops.lang_conf(docs, "k", "t", model, ["en", "de"], "en").collect())
    assert got[2] == got[3] == 0.5 and got[1] > 0.5
    texts = letters(4 * MB)
    sides = [textops.text_chunks(pa.array(texts), 3, 1 << 10), textops.text_chunks(pa.array(texts), 3)]
    sums = [np.zeros(len(texts), np.int64) for _ in sides]
    for s, side in zip(sums, sides, strict=True):
        for rows, part in side:
            s[rows] += textops.gram_keys(part, 3)[1]
    assert sums[0].tolist() == sums[1].tolist() == [len(t) - 2 for t in texts]


def test_spans_are_marked_a_slice_at_a_time(spark, given):
    texts = ["a  b , i " * 500] * 900 + [None, ""]
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    textops.mark_spans(df, "t")
    out, most = peak(lambda: [*given[-1](iter([pa.array(texts)]))])
    assert most < 60 * MB and sum(map(len, out)) == len(texts) and len(out) > 3
    assert pa.concat_arrays(out).slice(900).to_pylist() == [None, []]


def test_bleu_is_counted_a_slice_at_a_time(spark, given):
    df = spark.createDataFrame([("a b", "a b")], "h string, r string")
    textops.corpus_bleu(df, "h", "r")
    side = pa.array([list(range(k, k + 2000)) for k in range(1000)], pa.list_(pa.int64()))
    out, most = peak(lambda: [*given[-1](iter([pa.RecordBatch.from_arrays([side, side], names=["h", "r"])]))])
    assert most < 200 * MB
    assert [r for b in out for r in b.to_pylist()] == [{f"c{i}": x for i, x in enumerate([v * 1000 for n in range(4) for v in (2000 - n, 2000 - n)] + [2000 * 1000])}]


def test_shares_and_gradients_are_made_a_slice_at_a_time(spark, given):
    df = spark.createDataFrame([(1, [1])], "k int, ids array<int>")
    models.sparse_features(df.select("k", "ids"), F.col("ids"))
    ids = pa.array([None, *(np.arange(k, k + 2000, dtype=np.int32) for k in range(1000))], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001), pa.int32()), ids], names=["k", "_ids0"])
    out, most = peak(lambda: [*given[-1](iter([batch]))])
    assert most < 100 * MB and sum(b.num_rows for b in out) == 1001
    rows = [r for b in out for r in b.to_pylist()]
    assert rows[0]["idx"] == [] and all(len(r["idx"]) == 2000 and abs(sum(r["val"]) - 1) < 1e-9 for r in rows[1::100])


def test_parts_of_wide_rows_are_light(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BYTES_PER_PART", 10_000)
    df = spark.createDataFrame([(k, "x" * 1000) for k in range(100)], "k int, t string")
    cut = ordering.in_parts(df, [F.col("k")])
    assert max(r["count"] for r in cut.groupBy("_part").count().collect()) <= 30
    assert dict(ordering.positions(df, ["k"]).select("k", "idx").collect()) == {k: k for k in range(100)}
    assert ordering.in_parts(df.select("k"), [F.col("k")]).select("_part").distinct().count() == 1


def test_rules_are_tried_only_where_their_text_stands():
    tried = []

    class Pattern:
        def finditer(self, t):
            tried.append(t)
            return iter(())

    words = [f"w{k}x" for k in range(500)]
    made = automaton.RuleSet([(w, rf"\b{w} +{w}\b") for w in words])
    made.patterns = [Pattern() for _ in made.patterns]
    assert made.matches(" ".join(words) + "  w499x") == [(499, len(" ".join(words)) - 5, 12)] and not tried


def test_rules_tried_in_places_equal_a_search_along_the_text():
    rng = random.Random(1)
    patterns = [p for _, p in grammar.RULES] + [r"\bab +ab\b", r"\ba ab\b", "abab", "ab*a", r"(?<=a)bab", "bab(?!a)", "^aba", "aba$", "a{3}b{2,}c?", r"\Bba +", "aa|bb", "(ab){2,3}"]
    made = automaton.RuleSet([(str(k), p) for k, p in enumerate(patterns)])
    for _ in range(3000):
        t = "".join(rng.choices("aabbc  ,\n", k=rng.randrange(40)))
        assert made.matches(t) == [(k, m.start(), m.end() - m.start()) for k, p in enumerate(made.patterns) for m in p.finditer(t)]
