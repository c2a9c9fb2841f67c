"""JSON arrays read in ranges, and many rules in one pass."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefloom.functions import automaton, grammar, rewards, text
from prefloom.operators import textops
from prefloom.sources import arrays, files

SIGNS = '{}[],:"\\ ab\n🙂é/'


def some_items(rng, n):
    word = lambda k: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, k)))
    kinds = [
        lambda: {"query": word(30), "generation": word(60), "x": {"y": [word(5), {"z": word(9)}]}},
        lambda: None, lambda: 3.5, lambda: word(20), lambda: [word(4), {}], dict,
    ]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: (spark.conf.set("spark.sql.files.maxPartitionBytes", str(n)), spark.conf.set("spark.sql.files.openCostInBytes", "0"))
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [53, 1000, 1 << 27])
def test_arrays_of_any_elements_in_any_ranges(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    want = {}
    for k, n in enumerate((0, 1, 40, 300)):
        want[f"r{k}.json"] = some_items(rng, n)
        (tmp_path / f"r{k}.json").write_text(json.dumps(want[f"r{k}.json"], ensure_ascii=k % 2 == 0, indent=[None, 2][k % 2]))
    small_ranges(size)
    got = {}
    for r in arrays.read_elements(spark, str(tmp_path)).collect():
        got.setdefault(r.file.split("/")[-1], {})[r.idx] = json.loads(r.value)
    assert got == {k: dict(enumerate(v)) for k, v in want.items() if v}


def test_one_array_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    runs = spark.range(3000).selectExpr("if(id < 2900, 'big run', 'small') AS run", "if(id < 2900, id, id - 2900) AS idx", "concat('q}\"', id) AS query", "repeat('[{,', id % 5) AS generation")
    files.write_runs(runs, str(tmp_path / "runs"))
    assert sorted(p.name for p in (tmp_path / "runs").iterdir() if p.suffix == ".json") == ["big run.json", "small.json"]
    assert len(json.loads((tmp_path / "runs" / "big run.json").read_text())) == 2900
    small_ranges(10_000)
    back = files.read_runs(spark, str(tmp_path / "runs"))
    assert sorted(map(tuple, back.select("run", "idx", "query", "generation").collect())) == sorted(map(tuple, runs.collect()))
    big = str(tmp_path / "runs" / "big run.json")
    assert spark.read.option("lineSep", "}").text(big).rdd.getNumPartitions() > 8


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"  +", {"  "}), (r"\bi\b", {"i"}), (r"[,;:!?]{2,}", set(",;:!?")), (r"\bteh +cat", {" cat"}), (r"(?:colour|hue)s?", {"colour", "hue"}),
        (r"[a-z]+", None), (r"x*", None), (r"(?i)word", None), (r"(ab)c|d", {"abc", "d"}), (r"[.!?] +[a-z]", {" "}),
    ],
)
def test_factors(pattern, want):
    got = automaton.factors(pattern)
    assert got == want or (pattern == r"\bteh +cat" and got in ({"teh "}, {" cat"}))


def many_rules(n):
    words = [f"w{k}x" for k in range(n)]
    return [*grammar.RULES, *[(f"twice:{w}", rf"\b{w} +{w}\b") for w in words], ("digits", r"[0-9]{3,}"), ("either", r"(?:w1x|w2x)[,;]")]


def test_many_rules_equal_each_rule_for_itself(spark):
    rng = np.random.default_rng(4)
    rules = many_rules(520)
    words = [f"w{k}x" for k in range(12)] + ["i", "I", "end.", "no", ",;", "1234", "é🙂", "w1x,"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60))).replace(" no", "  no") for _ in range(80)] + ["", None, "w3x w3x"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = sorted(map(tuple, textops.grammar_matches(df, "k", "t", rules).collect()))
    some = [r for r in rules if any(r[0].endswith(f":w{k}x") for k in range(12)) or ":" not in r[0]]
    want = sorted(map(tuple, df.select("k", F.inline(grammar.matches("t", some))).collect()))
    assert got == want and len(got) > 100
    marks = textops.mark_spans(df, "t", rules=some).select("k", "grammar_rewards")
    plain = df.select("k", rewards.mark_tokens(text.word_spans("t"), grammar.matches("t", some), F.lit(0.0), F.lit(-1.0)).alias("m"))
    assert dict(map(tuple, marks.collect())) == dict(map(tuple, plain.collect()))


def test_rules_that_do_not_hit_are_not_tried():
    tried = []

    class Pattern:
        def __init__(self, name, pattern):
            self.name, self.pattern = name, pattern

        def finditer(self, t):
            tried.append(self.name)
            return self.pattern.finditer(t)

    made = automaton.RuleSet(many_rules(2000))
    made.patterns = [Pattern(n, p) for n, p in zip(made.names, made.patterns, strict=True)]
    assert [made.names[k] for k, _, _ in made.matches("a w7x w7x b")] == ["twice:w7x"]
    assert set(tried) <= {"twice:w7x", "digits", *(n for n, _ in grammar.RULES)}


def test_rule_tables_are_checked(spark, monkeypatch):
    table = spark.createDataFrame([("b", "x+"), ("a", "y"), (None, "z"), ("b", "x+")], "rule_id string, pattern string")
    assert automaton.rules_of(table) == [("a", "y"), ("b", "x+")]
    monkeypatch.setattr(automaton, "RULE_BYTES", 4)
    with pytest.raises(ValueError, match="bytes"):
        automaton.rules_of(table)
