"""Forests without a limit of depth: trees by hand, the Spark part against the plain one, the sizes of the query."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from padlens.operators import detectors as L
from padlens.operators import forest as G


def cells(seed=0, values=12, columns=3):
    random = np.random.default_rng(seed)
    codes = np.unique(random.integers(0, values, (600, columns)).astype("u1"), axis=0)
    counts = random.integers(0, 4, (len(codes), 2))
    return codes[counts.sum(axis=1) > 0], counts[counts.sum(axis=1) > 0]


def test_trees_grow_to_the_end():
    """All cells can be told apart, so without draws each leaf has the share of its own cell; 8 levels are not enough."""
    codes, counts = cells()
    weights = np.array([1.0, 1.7])
    own = (counts * weights)[:, 1] / (counts * weights).sum(axis=1)
    for take in (1, 3):
        got = G.tree(codes, counts, weights, codes, 1, take, None, np.random.default_rng(1))
        assert np.allclose(got, own, rtol=0, atol=1e-12)
    assert not np.allclose(G.tree(codes, counts, weights, codes, 1, 3, 8, np.random.default_rng(1)), own, atol=1e-3)


def test_a_split_is_the_best_by_gini():
    codes, counts = cells(3)
    weights, held = np.array([1.0, 1.7]), counts * np.array([1.0, 1.7])
    tried = []
    for j in range(3):
        for edge in range(11):
            left = codes[:, j] <= edge
            if min(counts[left].sum(), counts[~left].sum()) >= 40:
                sides = [held[s].sum(axis=0) for s in (left, ~left)]
                tried.append((sum(s.sum() * (1 - ((s / s.sum()) ** 2).sum()) for s in sides), tuple(np.where(left, *[s[1] / s.sum() for s in sides]))))
    assert np.allclose(G.tree(codes, counts, weights, codes, 40, 3, 1, np.random.default_rng(1)), min(tried)[1])


def test_leaves_hold_enough_rows():
    codes, counts = cells(5)
    shares = G.tree(codes, counts, np.ones(2), codes, 9, 2, None, np.random.default_rng(2))
    for share in np.unique(shares):
        assert counts[shares == share].sum() >= 9
        assert share == pytest.approx(counts[shares == share][:, 1].sum() / counts[shares == share].sum())


def test_scores_are_those_of_plain_trees(spark, monkeypatch):
    """Any number of parts, cells that no train row has, and repeated rows; a task grows one tree or all."""
    random = np.random.default_rng(7)
    rows = [(i, i % 9, "x", int(random.random() < 0.5), ["train", "train", "val", "test"][i % 4], float(random.integers(0, 8)), float(random.integers(0, 5))) for i in range(400)]
    rows = spark.createDataFrame(rows, "event_id long, user_id int, action string, label int, pool string, a double, b double")
    sizes = L.PUBLISHED | {"trees": 6}
    each = rows.select("pool", "label", F.col("a").cast("int"), F.col("b").cast("int")).collect()
    train = [r for r in each if r["pool"] == "train"]
    codes = np.array(sorted({(r["a"], r["b"]) for r in train}, key=lambda c: c[::-1]), "u1")
    counts = np.array([[sum((r["a"], r["b"], r["label"]) == (*c, k) for r in train) for k in (0, 1)] for c in codes])
    asked = np.array(sorted({(r["a"], r["b"]) for r in each}), "u1")
    want = dict(zip(map(tuple, asked.tolist()), G.trees(codes, counts, asked, range(6), 2, None) / 6))
    for parts, block in ((1, 6), (5, 1)):
        monkeypatch.setattr(G, "TREES", block)
        got = L.run_protocol(rows.repartition(parts), ["a", "b"], "forest", sizes)
        assert got.columns == ["event_id", "user_id", "action", "label", "pool", "score"]
        got = got.join(rows.select("event_id", "a", "b"), "event_id").collect()
        assert len(got) == 200 and {r["pool"] for r in got} == {"val", "test"}
        assert [r["score"] for r in got] == pytest.approx([want[r["a"], r["b"]] for r in got])


def test_the_forest_query_has_the_published_sizes(spark, monkeypatch):
    from padlens.plans import stream_queries as S

    def forest_scored(binned, rows, sizes):
        raise LookupError(sizes["trees"], sizes["depth"], sizes["leaf"])

    monkeypatch.setattr(G, "forest_scored", forest_scored)
    with pytest.raises(LookupError) as found:
        S.QUERIES["l3_forest"](spark, "/root/testdata/sf0.001")
    assert found.value.args == (500, None, 2)
