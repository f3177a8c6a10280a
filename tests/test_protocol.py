"""The protocol after the scores against NumPy, decisions, the fusion's refusals, and sessions at machine cadence."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from padlens.operators import detectors as L
from padlens.operators import metrics as M
from padlens.operators import sessions as N

SCORES = "event_id long, user_id long, action string, label int, pool string, detector string, score double"


def cell_scores(seed=3):
    rng, rows = random.Random(seed), []
    for action in ("tap", "pinch"):
        for detector in ("a", "b"):
            for i in range(600):
                label = rng.randrange(2)
                rows.append((i, rng.randrange(12), action, label, rng.choice(["val", "test"]), detector, round(rng.gauss(label * (1 + (detector == "b")), 1), 2)))
    return rows


def plain_cuts(real, fake):
    values = sorted({*real, *fake})
    cuts = [values[0], *[a + 0.5 * (b - a) for a, b in zip(values, values[1:])], float("inf")]
    points = [(np.mean(fake < c), np.mean(real >= c), c) for c in cuts]
    eer = min(points, key=lambda p: (abs(p[0] - p[1]), max(p[:2]), p[2]))[2]
    return eer, min((p for p in points if p[1] <= 0.05 + 1e-15), key=lambda p: (p[0], -p[1], p[2]))[2]


def test_cell_table_equals_numpy(spark):
    rows = cell_scores()
    got = L.cell_table(spark.createDataFrame(rows, SCORES), replicates=300).collect()
    assert len(got) == 4
    for r in got:
        of = lambda pool, label: np.array([x[6] for x in rows if x[2:6] == (r["action"], label, pool, r["detector"])])
        eer, frr5 = plain_cuts(of("val", 0), of("val", 1))
        assert (r["eer"], r["frr5"]) == pytest.approx((eer, frr5))
        for point, cut in (("eer", eer), ("frr5", frr5)):
            for pool in ("val", "test"):
                assert r[f"{pool}_{point}_far"] == pytest.approx(np.mean(of(pool, 1) < cut)) and r[f"{pool}_{point}_frr"] == pytest.approx(np.mean(of(pool, 0) >= cut))
            for rate in ("far", "frr"):
                low, high = r[f"{point}_{rate}_low"], r[f"{point}_{rate}_high"]
                assert low <= r[f"test_{point}_{rate}"] <= high and 0 < high - low < 0.4
        real, fake = of("test", 0), of("test", 1)
        assert r["auc"] == pytest.approx(np.mean([(f > real).mean() + (f == real).mean() / 2 for f in fake])) and (r["n_real"], r["n_fake"]) == (len(real), len(fake))


def test_one_call_from_features_to_cells(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(900):
        label = int(rng.integers(2))
        rows.append((i, int(rng.integers(10)), "tap" if i % 2 else "swipe", label, ["train", "val", "test"][i % 3], float(rng.normal(label * 2)), float(rng.normal())))
    rows += [(1000 + i, 1, "pinch", 1, "train", 0.0, 0.0) for i in range(5)]  # one class alone: no model, no cell
    table = spark.createDataFrame(rows, "event_id long, user_id long, action string, label int, pool string, f0 double, f1 double")
    got = L.protocol(table, ["f0", "f1"], ("linear_svm", "forest"), L.PUBLISHED | {"trees": 15, "depth": 4}, replicates=50)
    cells = {(r["action"], r["detector"]): r for r in got.collect()}
    assert set(cells) == {(a, k) for a in ("tap", "swipe") for k in ("linear_svm", "forest")} and all(r["auc"] > 0.85 for r in cells.values())
    assert L.grid_scores(table.filter("action = 'pinch'"), ["f0", "f1"], ("forest",)).collect() == []


def test_decisions_and_fusion_rows(spark):
    rows = [(1, 1, "tap", 0, "val", "a", 0.2), (1, 1, "tap", 0, "val", "b", 0.9), (2, 1, "tap", 1, "test", "a", 0.7), (3, 1, "tap", 1, "test", "c", 0.5)]
    cuts = spark.createDataFrame([("a", 0.5, 0.7), ("b", 0.3, 1.0)], "detector string, eer double, frr5 double")
    decided = L.decisions(spark.createDataFrame(rows, SCORES), cuts, ["detector"])
    got = {(r["event_id"], r["detector"]): (r["margin_eer"], r["reject_eer"], r["margin_frr5"], r["reject_frr5"]) for r in decided.collect()}
    assert got[1, "a"] == pytest.approx((-0.3, 0, -0.5, 0)) and got[1, "b"] == pytest.approx((0.6, 1, -0.1, 0)) and got[2, "a"] == pytest.approx((0.2, 1, 0.0, 1))
    assert got[3, "c"] == (None, None, None, None)
    with pytest.raises(Exception, match="several cuts"):
        L.decisions(spark.createDataFrame(rows, SCORES), cuts.unionByName(cuts), ["detector"]).collect()
    known = spark.createDataFrame([(1, 0.5), (2, 0.1)], "event_id long, consistency__lag double")
    fused, names = L.fusion_rows(decided, known, ["a", "b"])
    assert len(names) == 11 and [r["event_id"] for r in fused.collect()] == [1]  # sample 2 lacks a detector
    for args in ((decided, None, ["a"]), (decided, known.withColumnRenamed("consistency__lag", "lag"), ["a"]), (decided, known, ["a", "a"])):
        with pytest.raises(ValueError):
            L.fusion_rows(*args)


def test_sessions_at_machine_cadence(spark):
    rows = [(1, 1, "a", 0, 100, 1, None), (1, 1, "b", 5000, 5300, 2, 2.0), (1, 1, "a", 5300, 5350, 3, 1.5), (2, 1, "a", 70, 80, 4, None)]
    events = spark.createDataFrame(rows, "user_id long, session_id long, action string, start_ms long, end_ms long, event_id long, g double")
    got = [(r["event_id"], r["start_ms"], r["end_ms"]) for r in N.at_cadence(events, "g").orderBy("event_id").collect()]
    assert got == [(1, 0, 100), (2, 2100, 2400), (3, 3900, 3950), (4, 70, 80)]
    features = {r["user_id"]: r for r in N.rhythm_features(events.drop("g")).collect()}
    assert features[2]["repeat_rate"] == 1.0 and features[1]["repeat_rate"] == 0.0
    moved = N.gaps(N.at_cadence(events, "g")).filter(F.col("gap_s").isNotNull()).select("event_id", "gap_s").collect()
    assert {r["event_id"]: r["gap_s"] for r in moved} == {2: 2.0, 3: 1.5}


def test_phases_of_two_slots(spark):
    from padlens.operators import gestures as G

    contact = {0: "0111011", 1: "1101000"}
    rows = [(1, 1, t, 2 * t + s, int(c), s) for s, text in contact.items() for t, c in enumerate(text)]
    got = G.contact_phase(spark.createDataFrame(rows, "user_id long, act_id long, evt_t long, source_row long, contact int, slot int"), "slot").collect()
    phases = {s: [r["phase"] for r in sorted(got, key=lambda r: r["evt_t"]) if r["slot"] == s] for s in (0, 1)}
    assert phases == {0: [-1, 0, 2, 1, -1, 0, 1], 1: [5, 6, -1, 6, -1, -1, -1]}


def test_rank_statistic_equals_numpy(spark):
    rng = random.Random(9)
    rows = [(i % 3, i % 2, i % 2, round(rng.random(), 1), i) for i in range(200)]
    every = np.sort([r[3] for r in rows])
    p = np.clip([(np.searchsorted(every, r[3], "left") + np.searchsorted(every, r[3], "right")) / 2 / 200 for r in rows], 0.5 / 200, 1 - 0.5 / 200)
    want = {}
    for r, x in zip(rows, np.log(p / (1 - p))):
        want[r[:3]] = want.get(r[:3], 0) + x
    got = N.rank_statistic(spark.createDataFrame(rows, "user_id int, session_id int, label int, score double, event_id int"))
    assert {(r[0], r[1], r[2]): r["s5r_ranklogodds"] for r in got.collect()} == pytest.approx(want)


def test_duration_bins_have_an_auc_where_both_classes_are(spark):
    from padlens.operators import metrics as M

    rows = [(1.0, 0.2, 0), (1.0, 0.2, 1), (1.5, 0.9, 1), (5.0, 0.4, 0)]
    cuts = spark.createDataFrame([([2.0, 9.0],)], "cuts array<double>")
    got = {r["bin"]: (r["auc"], r["n_real"], r["n_fake"]) for r in M.duration_metrics(spark.createDataFrame(rows, "duration double, score double, label int"), cuts, 0.5).collect()}
    assert got == {0: (0.75, 1, 2), 1: (None, 1, 0), 2: (None, 0, 0)}


def test_style_distances_by_hand(spark):
    from padlens.operators import more as O

    # Two users on a line; train genuine rows have mean 0 and spread 1, so columns stay as they are.
    real = [(1, 1, 1, -1.0), (2, 1, 2, 1.0), (3, 2, 1, -1.0), (4, 2, 1, 1.0)]
    rows = [(i, u, s, 0, "train", x) for i, u, s, x in real] + [(5, 1, 9, 1, "test", 3.0), (6, 1, 9, 1, "test", 5.0)]
    got = {r["user_id"]: r for r in O.style_distances(spark.createDataFrame(rows, "event_id long, user_id long, session_id long, label int, pool string, x double"), ["x"]).collect()}
    assert [got[1][c] for c in ("fake_own", "real_own", "sessions_own", "others_own", "delta", "chain")] == pytest.approx([4.0, 1.0, 2.0, 1.0, -3.0, 0], abs=1e-6)
    assert got[2]["fake_own"] is None and got[2]["sessions_own"] is None and got[2]["others_own"] == pytest.approx(1.0)
    summary = O.style_summary(spark.createDataFrame(list(got.values()))).first()
    assert (summary["users"], summary["share_positive"]) == (1, 0.0)


def test_vector_draws_are_the_draws(spark, monkeypatch):
    """one row a user, over several blocks and hashed slot ranges, says what the rows of all replicates say."""
    from padlens.operators import replicates as V
    from padlens.operators import resample as R

    monkeypatch.setattr(V, "BLOCK", 8)
    monkeypatch.setattr(V, "CHUNK", 5)
    users = spark.createDataFrame([(i % 2, 3 * i) for i in range(41)], "label int, user_id long")
    got = V.vector_draws(users, 30, "x", ["label"])
    assert got.count() == 41
    times = {(r["label"], r["user_id"]): r["times"] for r in got.collect()}
    want = {k: bytearray(30) for k in times}
    for r in R.draws(users, 30, "x", ["label"]).collect():
        want[r["label"], r["user_id"]][r["rep"]] = r["mult"]
    assert {k: bytearray(v) for k, v in times.items()} == want


def test_replicate_sums_of_long_and_vector_draws(spark, monkeypatch):
    """equal sums by both forms, counts of more than a byte, cells sent before a task ends, replicates without users left out."""
    from padlens.operators import replicates as V

    monkeypatch.setattr(V, "HELD", 1)
    drawn = spark.createDataFrame([(0, 1, 2), (0, 2, 300), (2, 1, 1), (2, 3, 1)], "rep int, user_id long, mult long")
    counts = spark.createDataFrame([("a", 1, 5), ("a", 1, 1), ("a", 2, 3), (None, 2, 7), ("b", 9, 1)], "cell string, user_id long, v long")
    want = {("a", 0): 912.0, ("a", 2): 6.0, (None, 0): 2100.0}
    assert {(r["cell"], r["rep"]): r["v"] for r in V.replicate_sums(counts, drawn, ["cell"], ["v"]).collect()} == want


def test_user_vectors_go_to_tasks_once_however_many_cells(spark):
    """a user's cells share one row, so the vectors that reach Python are as many as users; sums are the same."""
    from padlens.operators import replicates as V

    drawn = V.vector_draws(spark.createDataFrame([(u,) for u in range(12)], "user_id long"), 15, "s")
    times = {r["user_id"]: r["times"] for r in drawn.collect()}
    counts = spark.createDataFrame([(c, u, c + u) for u in range(12) for c in range(9)], "cell long, user_id long, v long")
    out = V.replicate_sums(counts, drawn, ["cell"], ["v"])
    got = {(r["cell"], r["rep"]): r["v"] for r in out.collect()}
    assert got == {(c, k): float(sum(times[u][k] * (c + u) for u in times)) for c in range(9) for k in range(15)}
    met = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "_each" in met and out.count() == len(got)


def test_messages_of_slots_are_heads_and_numbers():
    """also where a head holds a line end."""
    from padlens.operators import replicates as V

    line = b"".join(b"\n%d" % s for s in range(9, 12))
    for head in (b"r2|0|", b"r2|0|a\nb|", b""):
        assert V.messages(head, line) == [head + b"%d" % s for s in range(9, 12)]


def test_bucket_wins_equal_the_loop_over_pairs():
    """ties, one side alone, weights over a byte."""
    import numpy as np
    import pyarrow as pa

    from padlens.operators import replicates as V

    random = np.random.default_rng(3)
    for sides, top in ((2, 3), (2, 300), (1, 3)):
        label, score, times = random.integers(0, sides, 60), random.integers(0, 9, 60).astype(float), random.integers(0, top, (60, 7))
        table = pa.table({"label": label, "score": score, "times": V.binaries(times)})
        real, fake, wins = V.bucket_wins(table, "score", "label", 7)
        pairs = [(times[i] * times[j], (score[j] > score[i]) + (score[j] == score[i]) / 2) for i in range(60) for j in range(60) if label[i] == 0 and label[j] == 1]
        assert wins == pytest.approx(sum((w * x for w, x in pairs), np.zeros(7)))
        assert (real == times[label == 0].sum(axis=0)).all() and (fake == times[label == 1].sum(axis=0)).all()


def bootstrapped(spark):
    """Three blocks of users, scores with ties within and across users, and the plain weights of each replicate."""
    import random

    from padlens.operators import replicates as V
    from padlens.operators import resample as R

    rng = random.Random(11)
    rows = [(f"c{i % 2}", i % 3 % 2, rng.randrange(20), float(rng.randrange(40))) for i in range(400)]
    users = spark.createDataFrame([(u,) for u in range(20)], "user_id long")
    plain = {}
    for r in R.draws(users, 25, "s").collect():
        plain.setdefault(r["rep"], {})[r["user_id"]] = r["mult"]
    return rows, spark.createDataFrame(rows, "cell string, label int, user_id long, score double"), V.vector_draws(users, 25, "s"), plain


def test_weighted_auc_by_buckets(spark, monkeypatch):
    """wins within and across buckets of scores, users from `vector_draws`, against the loop over pairs."""
    from padlens.operators import replicates as V
    from padlens.operators import resample as R

    monkeypatch.setattr(V, "BUCKET_ROWS", 20)
    rows, scores, drawn, plain = bootstrapped(spark)
    got = {(r["cell"], r["rep"]): r["auc"] for r in R.weighted_auc(scores, drawn, ["cell"]).collect()}
    assert len(got) == 50
    for (cell, rep), auc in got.items():
        w = lambda u: plain[rep].get(u, 0)  # noqa: B023, E731
        real = [(s, w(u)) for c, y, u, s in rows if c == cell and y == 0]
        fake = [(s, w(u)) for c, y, u, s in rows if c == cell and y == 1]
        wins = sum(a * b * ((s > t) + (s == t) / 2) for s, a in fake for t, b in real)
        assert auc == pytest.approx(wins / sum(a for _, a in fake) / sum(b for _, b in real))


def test_weighted_eer_by_buckets(spark, monkeypatch):
    """F8: the cut of each replicate lies in any bucket; all drawn scores are tried by the plain loop."""
    from padlens.operators import replicates as V
    from padlens.operators import resample as R

    monkeypatch.setattr(V, "BUCKET_ROWS", 20)
    rows, scores, drawn, plain = bootstrapped(spark)
    got = {(r["cell"], r["rep"]): r["eer"] for r in R.weighted_eer(scores, drawn, ["cell"]).collect()}
    assert len(got) == 50
    for (cell, rep), eer in got.items():
        met = [(y, s, plain[rep].get(u, 0)) for c, y, u, s in rows if c == cell and plain[rep].get(u, 0)]
        n = [sum(w for y, _, w in met if y == k) for k in (0, 1)]
        points = []
        for cut in sorted({s for _, s, _ in met}):
            fa, frr = sum(w for y, s, w in met if y == 1 and s < cut) / n[1], sum(w for y, s, w in met if y == 0 and s >= cut) / n[0]
            points.append((abs(fa - frr), cut, (fa + frr) / 2))
        assert eer == pytest.approx(min(points)[2])


def test_weighted_rows_of_several_kinds_of_batches(spark):
    """a task sends batches with nothing to add up and others, also where a column is marked as never null."""
    from padlens.operators import replicates as V

    drawn = V.vector_draws(spark.createDataFrame([(0,), (1,)], "user_id long"), 12, "s")
    counts = spark.range(0, 6000, 1, 1).select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("score"), F.when(F.col("id") < 3000, 1).otherwise(2).cast("long").alias("c"))
    assert not counts.schema["score"].nullable
    rows, n = V.weighted_rows(counts, drawn, ["score"], "c")
    times = drawn.filter("user_id = 0").first()["times"]
    got = {r["score"]: list(r["times"]) for r in rows.collect()}
    assert n == 12 and got == {k: [(1 if k < 3000 else 2) * t for t in times] for k in range(6000)}


def test_median_by_buckets(spark, monkeypatch):
    """both middle ranks, in one bucket or in two."""
    import statistics

    from padlens.operators import replicates as V
    from padlens.operators import reports as T

    monkeypatch.setattr(V, "BUCKET_ROWS", 3)
    _, _, drawn, plain = bootstrapped(spark)
    users = spark.createDataFrame([(u, float(u * u % 23)) for u in range(20)], "user_id long, delta double")
    got = {r["rep"]: r["median"] for r in T.median_delta(users, drawn).collect()}
    assert got == {rep: pytest.approx(statistics.median([float(u * u % 23) for u, m in w.items() for _ in range(m)])) for rep, w in plain.items()}


def test_clustered_rate_of_vectors(spark):
    """whole users drawn, from `vector_draws`."""
    from padlens.operators import reports as T

    rows, scores, drawn, plain = bootstrapped(spark)
    got = {r["rep"]: r["rate"] for r in T.clustered_rate(scores.selectExpr("user_id", "cast(label as double) as flag"), drawn).collect()}
    want = {rep: sum(y * w.get(u, 0) for _, y, u, _ in rows) / sum(w.get(u, 0) for _, _, u, _ in rows) for rep, w in plain.items()}
    assert got == pytest.approx(want)


def test_binned_rates_of_vectors(spark):
    """rates by arm and bin, from `vector_draws`."""
    from padlens.operators import reports as T

    rows, scores, drawn, plain = bootstrapped(spark)
    got = {(r["arm"], r["bin"], r["rep"]): r["rate"] for r in T.binned_rates(scores.withColumnsRenamed({"cell": "arm", "label": "bin"}), drawn, 20.0).collect()}
    want = {}
    for rep, w in plain.items():
        for arm, k in {(c, y) for c, y, _, _ in rows}:
            met = [(s, w.get(u, 0)) for c, y, u, s in rows if (c, y) == (arm, k)]
            want[arm, k, rep] = sum(m for s, m in met if s < 20) / sum(m for _, m in met)
    assert got == pytest.approx(want)


def test_no_task_gets_all_cuts_of_a_cell(spark):
    """With two cells a shuffle of every cut by cell alone would leave two tasks; only partial minima are shuffled by it."""
    rows = [(i, "ab"[i % 2], (i // 2) % 2, (i * 7919 % 4001) / 7.0) for i in range(4000)]
    scores = spark.createDataFrame(rows, "event_id long, detector string, label int, score double")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        cuts = M.select_cuts(scores, ["detector"])
        decided = L.decisions(scores, cuts, ["detector"])
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (cuts, decided, M.at_cut(scores, cuts, ["detector"], "eer"))]
        got = {r["detector"]: (r["eer"], r["frr5"]) for r in cuts.collect()}
    finally:
        for k in conf:
            spark.conf.unset(k)
    for plan in plans:
        joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
        assert all("_bucket" in line for line in joins) and "BroadcastHashJoin" in plan
    for d in "ab":
        real, fake = (np.array([r[3] for r in rows if r[1] == d and r[2] == k]) for k in (0, 1))
        assert got[d] == pytest.approx(plain_cuts(real, fake))


def test_trees_train_on_weighted_cells(spark):
    """Rows of equal bins and label become at most SHARES rows whose weights hold all rows; classes weigh the same; copies of
    all rows change no split where no rows are drawn."""
    from padlens.operators import detectors as L

    rows = [(float(i % 7), float(i * 37 % 101), int(i * 37 % 101 > 40 + 5 * (i % 7))) for i in range(300)]
    once = spark.createDataFrame(rows, "a double, b double, label int")
    many = once.crossJoin(spark.range(50).select())
    edges = L.bin_edges(many, ["a", "b"])
    assert edges[0] == [k + 0.5 for k in range(6)] and len(edges[1]) == 31 and edges[1] == sorted(edges[1])
    held = L.cell_shares(many.selectExpr("label", "a", "floor(b / 4) as b"), ["a", "b"]).collect()
    cells = {(y, a, b // 4) for a, b, y in rows}
    assert len(held) == len(cells) * L.SHARES < many.count() / 10
    for k in (0, 1):
        assert sum(r["weight"] for r in held if r["label"] == k) == pytest.approx(len(rows) * 50 / 2)
    sizes = L.PUBLISHED | {"rounds": 3, "subsample": 1.0, "leaf": 1}
    got = [[r["score"] for r in L.scored(L.fit_trees(train, ["a", "b"], "boosted", sizes), once).orderBy("a", "b").collect()] for train in (once, many)]
    right = [(s > 0.5) == (b > 40 + 5 * a) for s, (a, b, _) in zip(got[1], sorted(rows))]
    assert got[0] == pytest.approx(got[1]) and sum(right) > 0.9 * len(rows)
