"""Hand-made cells: edge cases and error paths, checked by hand or against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from prefloom.functions import rewards, stats, text
from prefloom.functions.common import prefix_sums
from prefloom.operators import compare, models, pairs, prep, requests, rollout, textops
from prefloom.operators.chunks import overlap_chunks
from prefloom.operators.ordering import collect_sequences, in_parts, positions, running
from prefloom.sources import files


def one(spark, expr, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()] or ["id"])
    return df.select(expr.alias("x")).first()["x"]


def test_running_matches_plain_sums_under_skew(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(10)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    out = running(df, F.col("v"), "s", ["i"], ["k"], rows=40).collect()
    best = {(r["k"], r["i"]): r["b"] for r in running(df, F.col("v"), "b", ["i"], ["k"], "max", False, rows=40).collect()}
    assert len(out) == 500
    for r in out:
        assert r["s"] == sum(v for k, i, v in rows if k == r["k"] and i <= r["i"])
        before = [v for k, i, v in rows if k == r["k"] and i < r["i"]]
        assert best[r["k"], r["i"]] == (max(before) if before else None)


def test_positions_keep_rows_of_a_null_group(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), ("a", 2)], "k string, i long")
    got = {(r["k"], r["i"]): r["idx"] for r in positions(df, ["i"], ["k"], rows=1).collect()}
    assert got == {(None, 1): 0, (None, 3): 1, ("a", 2): 0}


def test_parts_are_bounded_when_all_rows_share_one_hour_or_ids_are_sparse(spark):
    df = spark.range(2000).select(F.lit("2024-01-01").alias("ts"), (F.col("id") * 10**12).alias("i"))
    sizes = [r["count"] for r in in_parts(df, [F.col("ts"), F.col("i")], rows=100).groupBy("_part").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 300 and sum(sizes) == 2000
    got = {r["i"]: r["idx"] for r in positions(df, ["ts", "i"], rows=100).collect()}
    assert got == {k * 10**12: k for k in range(2000)}


def test_sequences_are_gathered_whole(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 1000), ("b", 4)) for i in range(n)], "k string, i long")
    got = {r["k"]: [x["i"] for x in r["items"]] for r in collect_sequences(df.repartition(7), "k", ["i"]).collect()}
    assert got == {"a": list(range(1000)), "b": [0, 1, 2, 3]}


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000])
def test_long_advantages_equal_a_plain_loop(spark, n):
    rng = random.Random(n)
    r, v, m = ([rng.uniform(-1, 1) for _ in range(n)] for _ in range(3))
    m = [float(x > -0.5) for x in m]
    want, following, behind = [0.0] * n, 0.0, 0.0
    for k in reversed(range(n)):
        behind = r[k] * m[k] + 0.9 * following - v[k] * m[k] + 0.9 * 0.95 * behind
        want[k], following = behind, v[k] * m[k]
    df = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<double>")
    got = df.select(stats.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.95).alias("a")).first()["a"]
    assert got == pytest.approx(want, abs=1e-9)


def test_prefix_sums_and_spans_of_long_texts(spark):
    for n in (0, 1, 64, 65, 200):
        counts = [(k * 7) % 5 for k in range(n)]
        df = spark.createDataFrame([(counts,)], "a array<int>")
        assert df.select(prefix_sums(F.col("a")).alias("s")).first()["s"] == [sum(counts[: k + 1]) for k in range(n)]
    t = "  ab c,  " * 150
    spans = spark.createDataFrame([(t,)], "t string").select(text.tokens_with_offsets("t").alias("s")).first()["s"]
    assert [(s["token"], s["start"]) for s in spans] == [x for k in range(150) for x in (("ab", 9 * k + 2), ("c,", 9 * k + 5))]


def test_padding_raises_instead_of_cutting(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([1],)], "t array<int>")
    assert [r["p"] for r in df.select(prep.pad_response(F.col("t"), 4).alias("p")).collect()] == [[2, 3, 0], [0, 0, 0]]
    with pytest.raises(Exception, match="longer than max_len"):
        df.select(prep.pad_response(F.col("t"), 2).alias("p")).collect()


def plain_starts(words, least=5):
    starts, previous = [0], 0
    for i in range(1, len(words)):
        if words[i - 1][-1] in ",;!?" and i + least < len(words):
            if i - previous >= least:
                starts.append(i)
                previous = i
            elif previous > 0:
                starts[-1] = i
                previous = i
    return starts


def test_piece_starts_against_plain_python(spark):
    rng = random.Random(7)
    lists = [[f"w{i}" + rng.choice(["", "", ",", ";", "!"]) for i in range(rng.randrange(1, 30))] for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in lists], "w array<string>").select("w", text.piece_starts(F.col("w")).alias("s"))
    for r in df.collect():
        assert r["s"] == plain_starts(r["w"])


def test_sentences_of_blank_and_odd_texts(spark):
    assert one(spark, text.sentence_ends("t"), t="   ") == [0]
    assert one(spark, text.sentence_ends("t"), t="") == [0]
    assert one(spark, text.sentence_ends("t"), t="Hi. You") == [0, 4, 7]
    assert one(spark, text.subsentence_cuts("t"), t="") == [0]
    words = one(spark, text.word_spans("t"), t="  a bc\n d")
    assert [(w["token"], w["start"], w["end"]) for w in words] == [("a", 2, 3), ("bc", 4, 6), ("d", 8, 9)]


def test_template_text_with_a_placeholder_is_filled_again(spark):
    filled = text.fill_template(F.lit("{a}-{b}"), {"a": F.lit("x{b}"), "b": F.lit("y")})
    assert one(spark, filled) == "xy-y"


def test_reward_arrays_at_the_edges(spark):
    assert one(spark, rewards.last_token_reward(F.lit(0), F.lit(2.0))) == [2.0]
    assert one(spark, rewards.last_token_reward(F.lit(3), F.lit(2.0))) == [0.0, 0.0, 2.0]
    assert one(spark, rewards.correct_rate(F.lit(0), F.lit(0))) == 0.5
    assert one(spark, rewards.strategy("hierarchical", F.col("a"), F.lit(0.5), F.lit(2), 2.0, 0.5), a=[1.0, 1.0]) == [1.0, 2.0]
    assert one(spark, rewards.strategy("hierarchical", F.col("a"), F.lit(0.49), F.lit(2), 2.0, 0.5), a=[1.0, 1.0]) == [0.0, 0.98]
    assert one(spark, rewards.last_attended(F.col("v"), F.col("m")), v=[5.0, 6.0], m=[0, 0]) == 5.0
    with pytest.raises(ValueError):
        rewards.strategy("other", F.lit(1), F.lit(1), F.lit(1))


def test_two_segments_on_one_token_and_one_outside(spark):
    segs = F.array(*[
        F.struct(F.lit(s).alias("seg"), F.lit(e).alias("end_pos"), F.lit(c).alias("correct"))
        for s, e, c in [(1, 2, False), (0, 2, True), (2, 0, True)]
    ])
    assert one(spark, rewards.scatter(F.lit(3), segs, F.lit(1.0), F.lit(-1.0))) == [1.0, 0.0, -1.0]


def plain_marks(tokens, spans):
    out = [0.0] * len(tokens)
    for offset, n in spans:
        first = next((i for i, (_, e) in enumerate(tokens) if e >= offset), None)
        if first is None:
            continue
        for i in range(first, len(tokens)):
            if tokens[i][1] - tokens[first][0] > n:
                break
            out[i] = -1.0
    return out


def test_mark_tokens_against_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(100):
        at, tokens = 0, []
        for _ in range(rng.randrange(0, 12)):
            start = at + rng.randrange(1, 3)
            at = start + rng.randrange(1, 6)
            tokens.append((start, at))
        rows.append((tokens, [(rng.randrange(0, 50), rng.randrange(1, 15)) for _ in range(rng.randrange(0, 4))]))
    df = spark.createDataFrame(rows, "t array<struct<start:int,end:int>>, s array<struct<offset:int,error_length:int>>")
    got = df.select("t", "s", rewards.mark_tokens(F.col("t"), F.col("s"), F.lit(0.0), F.lit(-1.0)).alias("r"))
    for r in got.collect():
        assert r["r"] == plain_marks([tuple(x) for x in r["t"]], [tuple(x) for x in r["s"]])


def test_masks_with_no_and_one_token(spark):
    df = spark.createDataFrame([("none", 1.0, 0), ("one", 2.0, 1), ("one", 9.0, 0)], "k string, v double, m int")
    mean = {r["k"]: r["mean"] for r in rollout.masked_mean(df, "v", "m", ["k"]).collect()}
    var = {r["k"]: r["var"] for r in rollout.masked_var(df, "v", "m", ["k"]).collect()}
    assert mean == {"none": None, "one": 2.0} and var == {"none": None, "one": None}


def test_whitened_values_have_mean_0_and_variance_1(spark):
    df = spark.range(100).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    r = rollout.whiten(df, "v").agg(F.avg("whitened").alias("m"), F.var_samp("whitened").alias("v")).first()
    assert abs(r["m"]) < 1e-9 and abs(r["v"] - 1) < 1e-9


def test_gae_of_one_and_of_no_token(spark):
    g = stats.gae(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.5)
    assert one(spark, g, r=[1.0], v=[0.25], m=[1]) == [0.75]
    assert one(spark, g, r=[1.0, 2.0], v=[0.5, 0.5], m=[1, 1]) == pytest.approx([1.0 + 0.45 - 0.5 + 0.45 * 1.5, 1.5])


def test_kl_kinds(spark):
    with pytest.raises(ValueError):
        stats.kl_penalty(F.lit(1.0), F.lit(1.0), "other")
    df = spark.createDataFrame([("a", 1, 1.0, 20_000_000)], "run string, step long, kl double, n_steps long")
    with pytest.raises(Exception, match="too large"):
        rollout.kl_coef(df, ["step"]).collect()


def test_flatten_rejects_the_separator(spark):
    df = spark.range(1).select(F.struct(F.lit(1).alias("a/b")).alias("s"))
    with pytest.raises(ValueError):
        rollout.flatten_struct(df)


def make_runs(spark, rows):
    return spark.createDataFrame(rows, "run string, idx long, holistic_reward double, error_rate double, generation string")


def test_all_ties_give_50_and_0(spark):
    df = make_runs(spark, [(r, i, 1.0, 0.5, "x") for r in "ab" for i in range(3)])
    rate = compare.win_rate(compare.win_counts(df, ["error_rate"])).collect()
    assert {(r["run_a"], r["tie"], r["win_rate"]) for r in rate} == {("a", 3, 50.0), ("b", 3, 50.0)}
    assert {r["holistic_reward_inconsistent"] for r in compare.inconsistency(df, ["error_rate"]).collect()} == {0.0}
    assert compare.trivial_ties(compare.run_pairs(df, ["generation"])).count() == 6


def test_lower_is_better_flips_only_the_inconsistency(spark):
    df = make_runs(spark, [("a", 0, 2.0, 0.1, "x"), ("b", 0, 1.0, 0.9, "y")])
    inc = {r["run_a"]: r["holistic_reward_inconsistent"] for r in compare.inconsistency(df, ["error_rate", "holistic_reward"]).collect()}
    wins = {r["run_a"]: r["win"] for r in compare.win_counts(df, ["error_rate"]).collect()}
    assert inc == {"a": 0.0, "b": 0.0} and wins == {"a": 0, "b": 1}


def test_win_counts_mirror(spark):
    rng = random.Random(5)
    df = make_runs(spark, [(r, i, float(rng.randrange(4)), float(rng.randrange(4)), "x") for r in "abc" for i in range(40)])
    rows = {(r["run_a"], r["run_b"]): (r["win"], r["lose"]) for r in compare.win_counts(df, ["error_rate"]).collect()}
    assert all(rows[b, a] == (lose, win) for (a, b), (win, lose) in rows.items())


def test_single_run_has_no_pairs(spark):
    df = make_runs(spark, [("a", 0, 1.0, 1.0, "x")])
    assert compare.win_counts(df, ["error_rate"]).count() == 0


def test_missing_and_unreadable_verdicts_are_ties(spark):
    p = spark.createDataFrame([(a, b, i) for a, b in ("ab", "ba") for i in range(4)], "run_a string, run_b string, idx long")
    v = spark.createDataFrame(
        [("a", "b", 0, 1), ("b", "a", 0, 0), ("a", "b", 1, 1), ("b", "a", 1, 1), ("a", "b", 2, 1), ("a", "b", 3, None), ("b", "a", 3, 1)],
        "run_a string, run_b string, idx long, verdict int",
    )
    got = {r["run_a"]: (r["win"], r["tie"], r["lose"]) for r in compare.judged_counts(p, v).collect()}
    assert got == {"a": (1, 3, 0), "b": (0, 3, 1)}


def test_pair_ties_count_for_accuracy_only(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0, 1.0)], "policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double")
    assert pairs.pair_report(df, "policy_chosen", "policy_rejected").first()["accuracy"] == 1.0
    assert pairs.dpo_report(pairs.dpo(df)).first()["rewards/accuracies"] == 0.0


def test_completion_mask_errors_and_fewer_responses(spark):
    with pytest.raises(Exception, match="response marker"):
        one(spark, pairs.completion_mask(F.col("a"), [5]), a=[1, 2, 3])
    assert one(spark, pairs.completion_mask(F.col("a"), [5]), a=[1, 5, 2, 5, 3]) == [-100, -100, -100, -100, 3]
    assert one(spark, pairs.completion_mask(F.col("a"), [5], [4]), a=[4, 1, 2]) == [-100, -100, -100]
    assert one(spark, pairs.completion_mask(F.col("a"), [5], [4]), a=[4, 1, 5, 2, 4, 3, 5, 6]) == [-100] * 3 + [2] + [-100] * 3 + [6]


def test_features_with_a_long_prompt_and_an_eos_inside(spark):
    df = spark.createDataFrame([(list(range(10, 20)), [50] * 6, [60])], "prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>")
    r = pairs.dpo_features(df, 8, 4).first()
    assert r["prompt_input_ids"] == [16, 17, 18, 19]
    assert r["chosen_labels"] == [-100] * 4 + [50] * 4 and r["rejected_input_ids"] == [16, 17, 18, 19, 60, 1]
    assert pairs.dpo_features(df, 8, 4, "keep_start").first()["prompt_input_ids"] == [10, 11, 12, 13]
    with pytest.raises(Exception, match="EOS"):
        pairs.dpo_features(df.withColumn("chosen_ids", F.array(F.lit(1))), 8, 4).collect()
    with pytest.raises(ValueError):
        pairs.dpo_features(df, 8, 4, "middle")
    with pytest.raises(ValueError):
        pairs.reward_collate(df, ["prompt_ids"])


def plain_pack(docs, length, eos):
    stream = [t for d in docs for t in [*d, eos]]
    return [stream[i : i + length] for i in range(0, len(stream) - length + 1, length)]


def test_packing_keeps_the_stream(spark):
    rng = random.Random(11)
    docs = [[rng.randrange(10, 99) for _ in range(rng.randrange(0, 40))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, ids array<int>")
    got = pairs.pack(df, "id", F.col("ids"), F.size("ids"), 16, 1).orderBy("chunk").collect()
    assert [r["input_ids"] for r in got] == plain_pack(docs, 16, 1)


def test_buffered_packing_against_plain_python(spark):
    rng = random.Random(12)
    docs = [[rng.randrange(10, 99) for _ in range(rng.randrange(0, 30))] for _ in range(50)]
    chars = [rng.randrange(1, 60) for _ in docs]
    df = spark.createDataFrame([(i, d, c) for i, (d, c) in enumerate(zip(docs, chars))], "id long, ids array<int>, c int")
    got = pairs.pack_buffered(df, "id", F.col("ids"), F.size("ids"), F.col("c"), 8, 1, 150, F.floor(F.col("id") / 20)).collect()
    want = set()
    for shard in range(3):
        buffers, held = [[]], 0
        for i in range(shard * 20, min(shard * 20 + 20, 50)):
            if held >= 150:
                buffers, held = [*buffers, []], 0
            buffers[-1].append(docs[i])
            held += chars[i]
        want |= {(shard, b, k, tuple(c)) for b, ds in enumerate(buffers) for k, c in enumerate(plain_pack(ds, 8, 1))}
    assert {(r["shard"], r["buffer"], r["chunk"], tuple(r["input_ids"])) for r in got} == want
    for key in {(r["shard"], r["buffer"]) for r in got}:
        placed = sorted(r["position"] for r in got if (r["shard"], r["buffer"]) == key)
        assert placed == list(range(len(placed)))


def test_collate_and_unpad(spark):
    df = spark.createDataFrame([(0, [1, 2]), (0, [3]), (1, [4])], "b long, a array<int>")
    left = prep.collate(df, ["b"], {"a": (0, "left")}, multiple=4).collect()
    assert sorted(tuple(r["a"]) for r in left) == [(0, 0, 0, 3), (0, 0, 0, 4), (0, 0, 1, 2)]


def test_eos_variants(spark):
    assert one(spark, prep.cut_at_eos(F.col("a"), 1, True), a=[5, 1, 6]) == [5, 1]
    assert one(spark, prep.cut_at_eos(F.col("a"), 1, False), a=[5, 1, 6]) == [5]
    assert one(spark, prep.length_before(F.col("a"), 1), a=[5, 6]) == 2
    assert one(spark, prep.pad_response(F.col("a"), 6), a=[9, 5, 6, 7]) == [5, 6, 7, 0, 0]


def test_overlapping_chunks(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "a array<int>")
    got = [r["chunk_ids"] for r in overlap_chunks(df, F.col("a"), 2).orderBy("chunk").collect()]
    assert got == [[1, 2, 3, 4], [3, 4, 5, 0], [5, 0, 0, 0]]


def test_bleu_of_equal_and_of_foreign_texts(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat .", "the cat sat on the mat .")], "id long, h string, r string")
    assert textops.corpus_bleu(df, "h", "r").first()["bleu"] == pytest.approx(100.0)
    df = spark.createDataFrame([(1, "a b c d e", "v w x y z")], "id long, h string, r string")
    smoothed = textops.corpus_bleu(df, "h", "r").first()["bleu"]
    assert smoothed == pytest.approx(100 * (1 / 2 / 5 * 1 / 4 / 4 * 1 / 8 / 3 * 1 / 16 / 2) ** 0.25)
    assert textops.corpus_bleu(df, "h", "r", smooth=False).first()["bleu"] == 0.0


def test_cooldowns_across_bucket_borders(spark):
    times = ["10:59:40", "10:59:50", "11:00:00", "11:00:10", "11:30:00", "12:59:59", "13:00:01"]
    df = spark.createDataFrame([(f"2024-01-01 {t}", "Rate limit") for t in times], "t string, error string").select(F.to_timestamp("t").alias("ts"), "error")
    got = sorted(r["n_errors"] for r in requests.cooldowns(df, 15).collect())
    assert got == [1, 2, 4]


@pytest.mark.parametrize("times", [["10:00:00", "10:00:15"], ["10:59:50", "11:00:05"]])
def test_spans_that_only_touch_stay_apart(spark, times):
    df = spark.createDataFrame([(f"2024-01-01 {t}", "Rate limit") for t in times], "t string, error string").select(F.to_timestamp("t").alias("ts"), "error")
    assert [r["n_errors"] for r in requests.cooldowns(df, 15).collect()] == [1, 1]
    assert [r["n_errors"] for r in requests.cooldowns(df, 16).collect()] == [2]


def test_overlapping_spans_of_shards_are_merged(spark):
    rows = [(0, 15, 1), (10, 40, 3), (12, 20, 1), (40, 55, 1), (54, 60, 2), (12, 20, 1)]
    df = spark.createDataFrame(rows, "a int, b int, n_errors long").select(F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"), "n_errors")
    out = requests.merge_spans(df, rows=2).select(F.unix_seconds("start"), F.unix_seconds("end"), "n_errors")
    assert sorted(tuple(r) for r in out.collect()) == [(0, 40, 6), (40, 60, 3)]


def test_bleu_counts_and_lengths_come_from_the_same_tokens(spark):
    t = "one two\u00a0three four five"
    df = spark.createDataFrame([(1, t, t), (2, "", ""), (3, None, "x")], "id long, h string, r string")
    out = textops.corpus_bleu(df, "h", "r").first()
    assert out["total1"] == out["ref_len"] and out["brevity_penalty"] == 1.0 and out["bleu"] == pytest.approx(100.0)


def test_clipped_counts_equal_plain_counters():
    from collections import Counter

    import numpy as np

    rng = random.Random(5)
    rows = [([rng.randrange(4) for _ in range(rng.randrange(9))], [rng.randrange(4) for _ in range(rng.randrange(9))]) for _ in range(60)]
    got = textops.clipped_counts(*[[np.array(r[k], np.int64) for r in rows] for k in (0, 1)], 4)
    for (h, r), counts in zip(rows, got.tolist()):
        want = []
        for n in range(1, 5):
            a, b = (Counter(zip(*(x[k:] for k in range(n)))) for x in (h, r))
            want += [(a & b).total(), a.total()]
        assert counts == want


def test_languages_are_scored_alike_in_place_and_by_join(spark, monkeypatch):
    rows = [(1, "the cat and the hat", "en"), (2, "le chat et le roi \U0001f642", "fr"), (3, None, "en"), (4, "", "fr"), (5, "ab", "en"), (6, "the the le", "xx")]
    df = spark.createDataFrame(rows, "id long, t string, lang string")
    model = textops.fit_lang(df, "t", "lang", ["en", "fr"])
    counts = {r["gram"]: r["counts"] for r in model.collect()}
    assert counts["the"] == [2, 0] and counts[" le"] == [0, 1] and counts["i \U0001f642"] == [0, 1]
    here = {r["id"]: r["confidence"] for r in textops.lang_conf(df, "id", "t", model, ["en", "fr"], "en").collect()}
    monkeypatch.setattr(textops, "MODEL_BYTES", 0)
    there = {r["id"]: r["confidence"] for r in textops.lang_conf(df, "id", "t", model, ["en", "fr"], "en").collect()}
    assert here == pytest.approx(there) and here[1] > 0.99 > 0.01 > here[2] and here[3] == here[4] == here[5] == 0.5


def test_message_with_a_name(spark):
    df = spark.sql("select array(named_struct('role', 'user', 'content', 'two words', 'name', 'bob')) as m")
    cost = requests.chat_cost(F.col("m"), ("role", "content", "name"), F.lit(None).cast("int"), F.lit(None).cast("int"))
    assert df.select(cost.alias("x")).first()["x"] == 4 + 1 + 2 + 1 - 1 + 2 + 15
    with pytest.raises(ValueError):
        requests.request_cost("audio", F.lit(1), F.lit(1), F.lit(1))


def test_run_files_and_existing_output(spark, tmp_path):
    (tmp_path / "gen.json.json").write_text('[{"query": "q", "generation": "g", "readability": 1.5}, {"query": "r"}]')
    rows = files.read_runs(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r["run"], r["idx"], r["query"], r["readability"]) for r in rows] == [("gen", 0, "q", 1.5), ("gen", 1, "r", None)]
    path = str(tmp_path / "out")
    assert files.write_once(spark, path, lambda: spark.range(3)).count() == 3
    assert files.write_once(spark, path, lambda: spark.range(9), use_cache=True).count() == 3
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_once(spark, path, lambda: spark.range(3))
    assert files.results_path("x.jsonl") == "x_results.jsonl"


def test_result_lines_with_and_without_metadata(spark):
    line = files.result_line(F.lit('{"a":1}'), F.lit('{"b":2}'), F.col("m"))
    assert one(spark, line, m="{}") == '[{"a":1}, {"b":2}]'
    assert one(spark, line, m='{"id":1}') == '[{"a":1}, {"b":2}, {"id":1}]'


def test_formatting_must_return_a_list(spark):
    df = spark.createDataFrame([(1, "a")], "id long, t string")
    with pytest.raises(Exception, match="must return a list"):
        models.format_examples(df, lambda b: "text", "id").collect()


def test_reward_model_learns_an_ordering(spark):
    df = spark.createDataFrame([(f"good text {i}", f"bad text {i}") for i in range(30)], "c string, r string")
    model = models.fit_reward(df, "c", "r", 256)
    scored = models.reward_score(models.reward_score(df, model, "c", "sc"), model, "r", "sr")
    assert scored.filter("sc <= sr").count() == 0


def test_unknown_endpoint_gives_null(spark):
    assert one(spark, text.endpoint("u"), u="https://host/other") is None
    assert one(spark, text.endpoint("u"), u="https://h/v1/chat/completions") == "chat/completions"
