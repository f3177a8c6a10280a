"""Quantiles by rank, the largest cut and stretches of a session, against the plain computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from padlens.functions.quantiles import by_rank, exact_quantiles, place, stepped
from padlens.operators import joins as J
from padlens.operators import sessions as N

LEVELS = [0.0, 0.001, 0.25, 1 / 3, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("by", [["k"], ["k", "m"], []])
def test_quantiles_by_rank_equal_percentile(spark, by):
    rng = random.Random(8)
    rows = [("hot", i % 2, rng.gauss(0, 50)) for i in range(3000)] + [("ties", 0, float(rng.randrange(5))) for _ in range(400)]
    rows += [("one", 1, 4.5), ("two", None, 1.0), ("two", None, 2.0), ("none", 1, None), (None, 1, 7.0), (None, 1, None), ("odd", 0, float("nan")), ("odd", 0, 1.0), ("odd", 0, float("inf"))]
    table = spark.createDataFrame(rows, "k string, m int, v double").repartition(3)
    plain = table.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, LEVELS))).alias("q"))
    key = lambda df: sorted(((*[r[k] for k in by], [f"{x:.12g}" for x in r["q"]] if r["q"] else None) for r in df.collect()), key=str)
    want = key(plain)
    assert key(exact_quantiles(table, by, "v", LEVELS)) == want
    assert key(exact_quantiles(table, by, "v", LEVELS, in_memory=0, parts=4)) == want


def test_weighted_quantiles(spark):
    rows = [(1, 3), (2, 0), (5, 2), (9, 1)]
    table = spark.createDataFrame([("a", float(v), w) for v, w in rows] + [("b", 1.0, 0)], "k string, v double, w int")
    q = np.quantile([v for v, w in rows for _ in range(w)], LEVELS)
    for limit in (0, 100):
        got = {r["k"]: r["q"] for r in exact_quantiles(table, ["k"], "v", LEVELS, F.col("w"), in_memory=limit).collect()}
        assert np.allclose(got["a"], q) and got["b"] is None


def test_no_rows_and_what_the_last_turn_sorts(spark):
    empty = spark.createDataFrame([], "k string, v double")
    for limit in (-1, 100):
        assert exact_quantiles(empty, ["k"], "v", [0.5], in_memory=limit).collect() == []
        assert [r["q"] for r in exact_quantiles(empty, [], "v", [0.5], in_memory=limit).collect()] == [None]
    counts = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("_v"), F.lit(1).cast("long").alias("_c"))
    assert by_rank(counts, [], [0.5, 0.9], parts=16).first()["q"] == pytest.approx([9999.5, 17999.1])


@pytest.mark.parametrize("ways", [2, 5, 32])
def test_largest_cut_equals_the_scan(spark, ways):
    rng = random.Random(ways)
    rows = [(u, round(rng.random() ** (1 + u % 3), 3)) for u in range(23) for _ in range(rng.randrange(1, 40))]
    table = spark.createDataFrame(rows, "user_id int, p double")
    for cap in (0.0, 0.01, 0.2, 0.5, 1.0):
        best, passed = None, 0
        for cut in sorted({p for _, p in rows}):
            rates = [np.mean([p <= cut for v, p in rows if v == u]) for u in range(23)]
            if np.percentile(rates, 90) > cap:
                break
            best, passed = cut, passed + 1
        assert tuple(N.largest_cut(table, cap, ways=ways).first()) == (best, passed)
    assert tuple(N.largest_cut(table.limit(0), 0.5).first()) == (None, 0)


def greedy(labels, found):
    """Session by session, over all of a session's labels at once."""
    out, taken = {}, set()
    for user, session, event, action, start, end in sorted(labels, key=lambda r: (*r[:2], J.PRIORITY.get(r[3], 5), r[4], r[5], r[2])):
        options = sorted((s, c) for u, k, e, c, s, _ in found if (u, k, e) == (user, session, event))
        score, contact = next((o for o in options if (user, session, o[1]) not in taken), (None, None))
        taken.add((user, session, contact))
        out[event] = (contact, score, J.ACCEPTED if contact is not None else J.RESERVED if options else J.UNMATCHED)
    return out


def test_stretches_assign_like_whole_sessions(spark):
    rng = random.Random(5)
    labels, found = [], []
    for i in range(600):
        at = rng.randrange(40_000)
        user, session = rng.randrange(2), rng.randrange(2)
        labels.append((user, session, i, rng.choice(["tap", "pinch", "keystroke", "swipe", "odd"]), at, at + rng.randrange(30)))
    for c in range(500):
        at, user, session = rng.randrange(40_000), rng.randrange(2), rng.randrange(2)
        for u, k, e, _, start, _ in labels:
            if (u, k) == (user, session) and abs(start - at) < 150:
                found.append((u, k, e, 5000 - c, float(rng.randrange(4)), at))
    a = spark.createDataFrame(labels, "user_id int, session_id int, event_id long, action string, start_ms long, end_ms long")
    b = spark.createDataFrame(found, "user_id int, session_id int, event_id long, contact_id long, score double, contact_ms long")
    want = greedy(labels, found)
    got = {r["event_id"]: (r["contact_id"], r["score"], r["status"]) for r in J.assign(a, b).collect()}
    assert got == want and {s for *_, s in want.values()} == {J.ACCEPTED, J.RESERVED, J.UNMATCHED}
    size = J.largest_stretch(a, b).first()
    assert size["labels"] == sum(s != J.UNMATCHED for *_, s in want.values()) and size["stretches"] > 10 * size["sessions"] and size["largest"] < 60
    assert J.assign(a, b.limit(0)).filter(F.col("status") != J.UNMATCHED).isEmpty() and J.assign(a.limit(0), b.limit(0)).isEmpty()


def test_stretches_are_walked_and_not_grouped(spark):
    """Many stretches, some over the border of a batch, cost no call each."""
    rng = random.Random(6)
    labels, found = [], []
    for i in range(900):
        user, session, at = i % 7, i % 3, (i // 3) * 1000
        labels.append((user, session, i, rng.choice(["tap", "pinch", "swipe", None]), at, at + 5))
        near, shared = (20_000 + i, at), (10_000 + i // 42, i // 42 * 14_000)  # a contact has one start
        found += [(user, session, i, c, float(rng.randrange(3)), start) for c, start in rng.choice([[], [near], [shared], [near, shared], [shared]])]
    found = sorted(set(found))
    a = spark.createDataFrame(labels, "user_id int, session_id int, event_id long, action string, start_ms long, end_ms long")
    b = spark.createDataFrame(found, "user_id int, session_id int, event_id long, contact_id long, score double, contact_ms long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = J.assign(a, b)
        got = {r["event_id"]: (r["contact_id"], r["score"], r["status"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = greedy(labels, found)
    assert got == want and {s for *_, s in want.values()} == {J.ACCEPTED, J.RESERVED, J.UNMATCHED}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def nested(queries, train):
    return {i: min((float(np.sqrt(np.mean((np.array(q) - np.array(x)) ** 2))) for j, x in train if j != i), default=None) for i, q in queries}


def test_least_distance_equals_the_nested_loop_with_fewer_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 30, (40, 6))
    train = [(i, (centres[i % 40] + rng.normal(0, 1, 6)).tolist()) for i in range(2000)]
    train += [(3000 + i, train[11][1]) for i in range(700)] + [(9000, [500.0] * 6)]  # copies, and one far from all
    queries = train[::20] + [(9000, [500.0] * 6), (9500, [0.0] * 6), (9600, train[0][1])]
    schema = "vec_id long, x array<double>"
    got = J.least_distance(spark.createDataFrame(queries, schema).repartition(3), spark.createDataFrame(train, schema).repartition(3)).collect()
    want = nested(queries, train)
    assert {r["query_id"]: r["distance"] for r in got} == pytest.approx(want)
    assert sum(r["compared"] for r in got) < 0.1 * len(queries) * 2001


@pytest.mark.parametrize("pivots", [1, 2, 9])
def test_least_distance_on_few_and_equal_vectors(spark, pivots):
    schema = "vec_id long, x array<double>"
    rng = random.Random(pivots)
    train = [(i, [float(rng.randrange(-2, 3)) for _ in range(3)]) for i in range(60)]
    for rows in (train, train[:2], [(1, [0.0]), (2, [0.0])], [(1, [1.0]), (2, [0.0])]):
        got = {r["query_id"]: r["distance"] for r in J.least_distance(spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema), pivots, 4).collect()}
        assert got == pytest.approx(nested(rows, rows))
    empty = spark.createDataFrame([], schema)
    assert J.least_distance(spark.createDataFrame(train, schema), empty).collect() == [] and J.least_distance(empty, spark.createDataFrame(train, schema)).collect() == []
    assert J.least_distance(spark.createDataFrame(train[:1], schema), spark.createDataFrame(train[:1], schema)).collect() == []


def test_least_distance_meets_in_blocks(spark, monkeypatch):
    """rings larger than a block, several blocks of queries, near ties and equal vectors."""
    import random

    monkeypatch.setattr(J, "TRAIN_BLOCK", 7)
    monkeypatch.setattr(J, "QUERY_BLOCK", 5)
    monkeypatch.setattr(J, "AT_ONCE", 3)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(1e3, 1) for _ in range(6)]) for i in range(60)]
    rows += [(60 + i, [v + 1e-7 * i for v in rows[i][1]]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, x array<double>")
    got = {r["query_id"]: r["distance"] for r in J.least_distance(df, df, 3, 2).collect()}
    want = {i: min(math.dist(x, y) for j, y in rows if j != i) / 6**0.5 for i, x in rows}
    assert got == pytest.approx(want, rel=1e-12, abs=1e-15)


def test_places_among_edges_by_two_short_steps(spark):
    rng = random.Random(8)
    edges = sorted(rng.randrange(300) / 4 for _ in range(1999))
    values = [None, -1.0, 0.0, 75.0, 1e9, float("nan"), *[rng.randrange(-4, 320) / 4 for _ in range(300)]]
    few = stepped(spark.createDataFrame([(edges,)], "e array<double>"), "e", 2000)
    heads, runs = few.select("_heads", "_runs").first()
    assert [e for r in runs for e in r] == sorted(set(edges)) and len(heads) <= 45 and max(map(len, runs)) <= 45  # a value meets 90 edges at most
    got = spark.createDataFrame([(v,) for v in values], "v double").crossJoin(few).select("v", place(F.col("v")).alias("n")).collect()
    for v, n in got:
        assert n == (0 if v is None else sum(e <= v or v != v for e in set(edges)))
    none = stepped(spark.createDataFrame([(None,), ([],)], "e array<double>"), "e", 2000)
    assert [r["n"] for r in none.select(place(F.lit(1.0)).alias("n")).collect()] == [0, 0]
