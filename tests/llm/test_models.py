"""The parts of the two text models against plain computations: word vectors, pooling, tree splits and leaves, isotonic fit."""

import numpy as np
import pytest

from padlens.llm import quality, toxicity

TEXTS = ["the cat sat on the mat", "the the cat", "", None, "one", "a, b; c! the cat -- the mat 42", "ünï çödé the cat"]


def words(text):
    bucket, at = quality.tokens([text or ""])
    return bucket.tolist()


def test_word_vectors_add_up_their_neighbours(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    want = np.zeros((quality.BUCKETS, quality.LENGTH))
    for text in TEXTS:
        seen = words(text)
        for k, word in enumerate(seen):
            for other in [*seen[max(k - 1, 0) : k], *seen[k + 1 : k + 2]]:
                for place, sign in zip(quality._PLACE[other], quality._SIGN[other]):
                    want[word, place] += sign
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(quality.word_vectors(docs), want / np.maximum(length, 1e-9), atol=1e-6)


def test_pooling_equals_word_by_word():
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(quality.BUCKETS, quality.LENGTH)).astype(np.float32)
    got = quality.pooled([t or "" for t in TEXTS], vectors)
    for row, text in zip(got, TEXTS):
        seen = words(text)
        if not seen:
            assert not row.any()
            continue
        v = vectors[seen].astype(float)
        beside = sum(float(a @ b) for a, b in zip(v, v[1:])) / len(seen)
        same = sum(a == b for a, b in zip(seen, seen[1:])) / len(seen)
        assert row == pytest.approx([*v.mean(0), *v.std(0), beside, same, np.log1p(len(seen)) / 10], abs=1e-4)


def test_isotonic_fit_equals_the_minimax_formula():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 60):
        x, y = rng.permutation(n).astype(float), (rng.random(n) < 0.4).astype(float)
        y = y[np.argsort(x)]
        x = np.sort(x)
        fit = [max(min(y[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        ladder = toxicity.Ladder(x[::-1], y[::-1])
        assert (np.diff(ladder.value) > 0).all() and ladder.value == pytest.approx(np.unique(np.round(fit, 12)))
        centres = [x[np.isclose(fit, v)].mean() for v in ladder.value]
        assert ladder.at == pytest.approx(centres)


def test_first_tree_takes_the_best_cut_of_all(monkeypatch):
    monkeypatch.setattr(toxicity, "TREES", 1)
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, (800, 4)).astype(float)
    y = ((x[:, 2] > 7) ^ (rng.random(800) < 0.1)).astype(float)
    trees = toxicity.Trees(x, y)
    p = 1 / (1 + np.exp(-trees.base))
    g, h = p - y, np.full(800, p * (1 - p))
    gains = {}
    for j in range(4):
        for edge_number, edge in enumerate(trees.edges[j]):
            left = x[:, j] <= edge
            if h[left].sum() >= toxicity.LEAST and h[~left].sum() >= toxicity.LEAST:
                part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
                gains[j, edge_number] = part(left) + part(~left) - part(left | ~left)
    feature, cut, leaf = trees.trees[0]
    assert gains[feature[0], cut[0]] == pytest.approx(max(gains.values())) and feature[0] == 2
    node = np.zeros(800, int)
    for _ in range(toxicity.DEPTH):
        bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(trees.edges)], axis=1)
        node = 2 * node + 1 + (bins[np.arange(800), feature[node]] > cut[node])
    node -= 2**toxicity.DEPTH - 1
    for k in np.unique(node):
        assert leaf[k] == pytest.approx(-toxicity.STEP * g[node == k].sum() / (h[node == k].sum() + 1))
    assert trees.margin(x) == pytest.approx(trees.base + leaf[node])
