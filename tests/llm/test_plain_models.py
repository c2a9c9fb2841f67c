"""The fitted models against plain versions: the recurrent labeller block by block and unit by unit, the quality scores with all rows in one place."""

import math
import zlib

import numpy as np

from prefloom.llm import html, quality


def plain_lstm(x, wx, wh, b, hidden):
    """Hidden states of one sequence, one gate value at a time."""
    s = lambda v: 1 / (1 + math.exp(-max(-30.0, min(30.0, v))))
    state, cell, out = [0.0] * hidden, [0.0] * hidden, []
    for row in x:
        g = [float(b[j]) + sum(float(v) * float(w) for v, w in zip(row, wx[:, j], strict=True)) + sum(h * float(w) for h, w in zip(state, wh[:, j], strict=True)) for j in range(4 * hidden)]
        take, forget, give, new = ([*map(s, g[k * hidden : (k + 1) * hidden])] if k < 3 else [*map(math.tanh, g[3 * hidden :])] for k in range(4))
        cell = [f * c + i * n for f, c, i, n in zip(forget, cell, take, new, strict=True)]
        state = [o * math.tanh(c) for o, c in zip(give, cell, strict=True)]
        out.append(state)
    return out


def test_labels_equal_a_plain_lstm():
    model = html.Labeller(4, 7)
    rng = np.random.default_rng(1)
    for k in model.p:
        model.p[k] = (model.p[k] + rng.normal(size=model.p[k].shape) * 0.3).astype(np.float32)
    pages = [html.blocks_of("".join(f"<div class=k{j % 3}><p>words {j}, more.</p><a href=x>link</a></div>" for j in range(n))) for n in (1, 3, 7)] + [[]]
    for blocks, got in zip(pages, model.label(pages), strict=True):
        x = html.vectors([blocks])
        p = model.p
        forward = plain_lstm(x, p["wxf"], p["whf"], p["bf"], 4)
        backward = plain_lstm(x[::-1], p["wxb"], p["whb"], p["bb"], 4)[::-1]
        want = [1 / (1 + math.exp(-(float(p["bo"][0]) + sum(h * float(w) for h, w in zip([*f, *b], p["wo"][:, 0], strict=True))))) for f, b in zip(forward, backward, strict=True)]
        assert np.allclose(got, want, atol=1e-5)


def plain_pools(points):
    """Isotonic regression by merging neighbours until none falls: (centre, level) of each pool."""
    pools = [[[a], [v], [w]] for a, v, w in sorted(points)]
    mean = lambda v, w: sum(x * y for x, y in zip(v, w, strict=True)) / sum(w)
    k = 0
    while k < len(pools) - 1:
        if mean(*pools[k][1:]) >= mean(*pools[k + 1][1:]):
            pools[k] = [x + y for x, y in zip(pools[k], pools.pop(k + 1), strict=True)]
            k = max(k - 1, 0)
        else:
            k += 1
    return [mean(p[0], p[2]) for p in pools], [min(1.0, max(0.0, mean(p[1], p[2]))) for p in pools]


def test_quality_scores_equal_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    words = ["river", "stone", "walks", "BRIGHT", "sky,", "and", "the", "mill.", "!!!", "4711", "é"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 60), p=None if k % 3 else [0.02, 0.02, 0.02, 0.2, 0.1, 0.02, 0.02, 0.1, 0.3, 0.1, 0.1])) for k in range(260)]
    marks = {k: int((k % 3 > 0) ^ (rng.random() < 0.1)) for k in range(200)}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    setup = quality.Setup(features=24, bins=64)
    got = {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(list(marks.items()), "doc_id long, quality int"), setup=setup).collect()}

    x = np.array([quality.statistics(t) for t in texts])
    crc = np.array([zlib.crc32(str(k).encode()) for k in range(260)])
    known = np.array([k for k in marks if crc[k] % 5])
    y, fold = np.array([marks[k] for k in known], float), crc[known] // 5 % setup.folds
    mean, scale = x[known].mean(0), x[known].std(0)
    scale[scale < 1e-9] = 1.0
    z = quality.features(x, mean, scale, setup)

    def ridge(rows, target):
        return np.linalg.solve(rows.T @ rows + setup.ridge * len(rows) * np.eye(rows.shape[1]), rows.T @ target)

    left_out = np.zeros(len(known))
    for f in range(setup.folds):
        left_out[fold == f] = z[known[fold == f]] @ ridge(z[known[fold != f]], y[fold != f])
    bins = {}
    for raw, label in zip(left_out, y, strict=True):
        bins.setdefault(int(np.clip(math.floor((raw + 1) / 3 * setup.bins), 0, setup.bins - 1)), []).append((raw, label))
    centres, levels = plain_pools([(np.mean([r for r, _ in b]), np.mean([v for _, v in b]), float(len(b))) for b in bins.values()])
    want = np.interp(z @ ridge(z[known], y), centres, levels)
    assert np.allclose([got[k] for k in range(260)], want, atol=1e-6) and want.std() > 0.1
