"""Fill-in-the-middle, conversation repair and exact product search against plain versions of themselves, and on odd rows."""

import hashlib
import heapq
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefloom.llm import infill, products, repair

# ---- fill-in-the-middle

DOCS = "doc_id bigint, text string, n int, form string, frames int, ends string, k string, _digits string"


def docs_of(spark, rows):
    return spark.createDataFrame([(k, t, 1, "f", 2, "e", "k", "d") for k, t in rows], DOCS)


def plain_infill(key, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ODD = [(None, None), (None, "a null key"), (1, ""), (2, "x"), (3, "é🙂 < P> <S"), (4, "has <P> in it"), (5, "has <M>"), (6, "word " * 50_000), (6, "word " * 50_000), (7, "<<SS>>" * 9)]


@pytest.mark.parametrize("units", [3, 1000, infill.UNITS])
def test_infill_equals_the_plain_cut_and_comes_back(spark, units):
    rows = ODD + [(k, f"text {k} 🙂 " * (k % 7)) for k in range(10, 80)]
    docs = docs_of(spark, rows if units > 3 else [r for r in rows if len(r[1] or "") < 1000])
    given_ = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    made = infill.infill(infill.plan(infill.store(docs, units=units)), units=units)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()), key=repr)
    assert got == sorted(((k, *plain_infill(k, t)) for k, t in given_), key=repr)
    back = sorted(((r.doc_id, r.text) for r in infill.restore(made).collect()), key=repr)
    assert back == sorted(((k, t or "") for k, t in given_), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in infill.digest(docs, units=units).collect()), key=repr)
    assert digests == sorted(((k, sha(plain_infill(k, t)[-1]), sha(t or "")) for k, t in given_), key=repr)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}


def test_infill_of_nothing(spark):
    assert infill.digest(docs_of(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>PSM🙂a", max_size=40), st.integers(1, 9), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]))
def test_cuts_come_back_from_their_output(text, units, one, two, form):
    if any(m in text for m in infill.MARKS):
        return
    a, b = sorted((min(one, len(text)), min(two, len(text))))
    frames = infill.Frames.of([text[:a], text[a:]], units)
    assert len(frames) == len(text) and "".join(frames.span(a, b)) == text[a:b]
    out = infill.Frames.of(infill.reordered(frames, form, a, b), units)
    assert "".join(infill.restored(out, form)) == text


def test_spans_read_only_the_frames_they_touch(monkeypatch):
    frames = infill.Frames.of(["abcdefghij" * 100], 10)
    read = []
    codec = infill._codec()[1]
    monkeypatch.setattr(infill, "_codec", lambda: (None, type("C", (), {"decompress": lambda self, d: read.append(d) or codec.decompress(d)})()))
    assert "".join(frames.span(505, 525)) == "fghijabcdefghijabcde" and len(read) == 3
    assert frames.find("ja", 505) == 509


# ---- conversation repair


def plain_faults(rows):
    seen, faults = set(), []
    for role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return faults


def plain_repair(rows):
    """Cheapest edits by searching all of them, cheapest and then least first."""
    faults = plain_faults(rows)
    start = (0, "", 0, "", ())
    queue, best = [start], None
    while queue:
        cost, audit, at, roles, out = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, out)
            continue
        if len(audit) > 3 * len(rows) + 3:
            continue
        steps = [(2, "I", at, name, (name, "")) for name in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            steps.append((3, "D", at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                extra = int(faults[at] == "truncated")
                steps.append((extra, "K", at + 1, role, (role, text)))
                steps += [(2 + extra, "R", at + 1, name, (name, text)) for name in ("user", "assistant")]
        for price, edit, then, name, row in steps:
            now = roles + (name[:1] if name is not None else "")
            if name is None or re.match(r"s?(ua)*u?\Z", now) and name[:1]:
                heapq.heappush(queue, (cost + price, audit + edit, then, now, out + ((row,) if row else ())))
    return best


def plain_result(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha of (turn, role, text) rows in order."""
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, t) for _, r, t in rows]
    faults = plain_faults(pairs)
    illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(pairs, pairs[1:], strict=False))
    cost, audit, out = plain_repair(pairs)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def hurt(rows):
    """The damage, row by row."""
    out = []
    for talk, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if talk is None else talk}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(talk, turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest()))


TALKS = "conv_id bigint, turn bigint, role string, text string, talk int, seg string, audit string, gone int"
RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def some_talks(seed, talks=40):
    rng = np.random.default_rng(seed)
    rows = []
    for talk in [None, *range(talks)]:
        for turn in range(int(rng.integers(0, 8))):
            role = ["user", "assistant", "system", "unknown", None, "", "tool"][int(rng.choice(7, p=[0.3, 0.3, 0.15, 0.1, 0.05, 0.05, 0.05]))]
            text = ["Yes.", "No end", "", " \n", None, "Why?", "x. "][int(rng.integers(7))]
            rows.append((talk, None if rng.random() < 0.05 else turn + (rng.random() < 0.1), role, text))
    return rows


@pytest.mark.parametrize(("seed", "limits"), [(0, repair.Limits()), (1, repair.Limits(together=3)), (2, repair.Limits(rows=2)), (3, repair.Limits(rows=1)), (4, repair.Limits(rows=3, bytes=5))])
def test_repair_equals_the_search_of_all_edits(spark, seed, limits):
    rows = some_talks(seed)
    df = spark.createDataFrame([(c, t if t is None else int(t), r, x, 1, "s", "a", 0) for c, t, r, x in rows], TALKS)
    got = {r["conv_id"]: tuple(r[c] for c in RESULT[1:]) for r in repair.repair(repair.damage(df), limits=limits).collect()}
    want = {}
    damaged = hurt(rows)
    for talk in {r[0] for r in rows}:
        want[talk] = plain_result(ordered([r[1:] for r in damaged if r[0] == talk]))
    assert got == want


def test_repaired_rows_are_those_of_the_digest(spark):
    df = spark.createDataFrame([(c, t if t is None else int(t), r, x, 1, "s", "a", 0) for c, t, r, x in some_talks(7)], TALKS)
    rows = repair.damage(df)
    digests = {r.conv_id: r.repaired_sha256 for r in repair.repair(rows).collect()}
    lines = {}
    for r in sorted(repair.repaired(rows, limits=repair.Limits(rows=2)).collect(), key=lambda r: (r.part, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for talk, sha in digests.items():
        assert hashlib.sha256("\n".join(lines.get(talk, [])).encode()).hexdigest() == sha
        assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in lines.get(talk, [])))


def test_one_conversation_with_most_rows_is_cut(spark):
    n = 3000
    rows = [(1, k // 2, ["user", "assistant", "tool"][k % 3], f"Text {k % 700}" + "." * (k % 5 > 0), 1, "s", "a", 0) for k in range(n)] + [(2, 0, "user", "Hi.", 1, "s", "a", 0)]
    df = spark.createDataFrame(rows, TALKS)
    whole, cut = (sorted(map(tuple, repair.repair(repair.rows_of(df), limits=x).collect())) for x in (repair.Limits(), repair.Limits(rows=97)))
    assert whole == cut and [r[0] for r in whole] == [1, 2]
    # forward costs by state, one row after the other
    ranked = ordered([(r[1], r[2], r[3]) for r in rows[:n]])
    far, faults = 10**9, plain_faults([r[1:] for r in ranked])
    cost = [0, far, far, far]
    close = lambda c: [c[0], c[1], min(c[2], c[0] + 2, c[1] + 2, c[3] + 2), min(c[3], min(c[2], c[0] + 2, c[1] + 2) + 2)]
    for (_, role, _), fault in zip(ranked, faults, strict=True):
        c = close(cost)
        cost = [x + 3 for x in c]
        if fault not in ("blank", "duplicate"):
            t = int(fault == "truncated")
            for s, to in enumerate((2, 2, 3, 2)):
                cost[to] = min(cost[to], c[s] + 2 + t)
            for s, to in {"u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}.get(role[0], ()):
                cost[to] = min(cost[to], c[s] + t)
    cost = close(cost)
    assert whole[0][6] == min(cost[0], cost[3])


def test_repair_of_nothing_and_of_gone_rows(spark):
    assert repair.repair(repair.damage(spark.createDataFrame([], TALKS))).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.", 1, "s", "a", 0)], TALKS)
    row = repair.repair(repair.damage(df)).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ranks_follow_the_audits():
    rng = np.random.default_rng(5)
    size = rng.integers(0, 9, 60)
    kinds = rng.integers(0, 16, int(size.sum()))
    kinds = np.where(kinds // 2 % 2 == 1, kinds // 2 * 2, kinds)
    paths = repair.solve(kinds, size, np.repeat(repair.END[None], 60, axis=0), np.ones(60, bool))
    nodes = np.arange(len(paths.label))
    audits, ends = paths.audits(nodes)
    assert [paths.rank[k] for k in sorted(nodes, key=lambda k: audits[k])] == sorted(paths.rank)
    assert not paths.label[ends].any()


# ---- products


def plain_products(rows, k=5, scale=256):
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([int(math.floor(x * scale)) for x in v])
    out = []
    for q in fine:
        if q % 50 == 0:
            for own in {tuple(v) for v in fine[q]}:
                found = [(-clip(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, vs in fine.items() if i != q for v in vs if len(v) == len(own)]
                out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


VECTORS = "vec_id bigint, embedding array<double>, label int, row string, level int, dim string, norm string, v string, id string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "r", 2, "d", "n", "v", "i") for i, v in rows], VECTORS)


def some_vectors(seed, n=600, dim=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.exp(rng.normal(size=n) * 1.2)[:, None]
    v[rng.random(n) < 0.3] = v[0]  # a third are copies
    rows = [(k, list(x)) for k, x in enumerate(v)]
    nan, inf = float("nan"), float("inf")
    return rows + [(50, None), (None, [1.0] * dim), (700, [0.0] * dim), (750, [nan] * dim), (751, [inf] * dim), (752, [None] * dim), (753, []), (800, []), (801, [1.0]), (850, [2.0]), (7, [1.0] * dim), (7, [1.0] * dim)]


@pytest.mark.parametrize(("seed", "top"), [(0, products.TopK()), (1, products.TopK(shard=50, block=5)), (2, products.TopK(coordinate_from=0.0, share=1.0, shard=200)), (3, products.TopK(coordinate_from=0.0, share=0.5, focus=1, cells=64))])
def test_products_equal_all_pairs(spark, seed, top):
    rows = some_vectors(seed)
    got = products.largest(vectors_of(spark, rows), F.col("vec_id") % 50 == 0, top=top)
    assert sorted(map(tuple, got.collect())) == plain_products(rows)


def test_products_of_large_numbers_and_of_nothing(spark):
    rng = np.random.default_rng(9)
    rows = [(k, list(rng.normal(size=4) * 10.0 ** rng.integers(0, 9))) for k in range(120)]
    got = products.largest(vectors_of(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_products(rows)
    assert products.largest(vectors_of(spark, []), F.col("vec_id") % 50 == 0).collect() == []
    assert products.largest(vectors_of(spark, [(1, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []


def test_a_query_id_in_very_many_rows_hides_no_other(spark):
    rows = [(0, [1.0, 1.0])] * 300 + [(k, [0.5, k / 100]) for k in range(1, 40)]
    got = products.largest(vectors_of(spark, rows), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == plain_products(rows)


def test_high_thresholds_read_by_coordinate(monkeypatch):
    rng = np.random.default_rng(3)
    v = np.floor(rng.normal(size=(4000, 16)) * 256)
    v[:200] = np.floor(v[200] + rng.normal(size=(200, 16)) * 8)
    calls = []
    plain = products.by_length
    monkeypatch.setattr(products, "by_length", lambda b, best, q, need, cells: calls.append(len(q)) or plain(b, best, q, need, cells))
    q = v[200:201]
    first = products.search(v[:300], np.arange(300), q, np.array([200]), np.array([-np.inf]), products.TopK())
    calls.clear()
    best = products.search(v, np.arange(4000), q, np.array([200]), first.score[:, -1], products.TopK(share=1.0))
    score = (v @ q[0])
    score[200] = -np.inf
    want = np.lexsort((np.arange(4000), -score))[:5]
    assert best.found[0].tolist() == want.tolist() and sum(calls) == 0
