"""Steps that must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from padlens.operators import detectors as L


def fourier_rows(spark, copies=1):
    rows = spark.range(200 * copies).select((F.col("id") % 200).alias("i"), F.lit("train").alias("pool"))
    return rows.select((F.col("i") % 2).cast("int").alias("label"), F.sin("i").alias("a"), F.cos(F.col("i") * 3).alias("b"))


def test_fourier_features_are_one_matrix_a_batch(spark):
    rows = fourier_rows(spark)
    got = L.with_fourier(rows, ["a", "b"])
    assert len(got.columns) == len(rows.columns) + 1 and str(got._jdf.queryExecution().optimizedPlan()).count("COS(") <= 1
    random = np.random.default_rng(3)
    w, b = random.normal(0, 2**-0.5, (64, 2)), random.uniform(0, 2 * np.pi, 64)
    for r in got.collect():
        assert np.allclose(r["features"].toArray(), np.cos(w @ [r["a"], r["b"]] + b), rtol=0, atol=1e-13)
    model = L.fit_fourier(rows, ["a", "b"])
    rows = L.fourier_scored(model, got, ["a", "b"]).collect()
    assert np.allclose([r["score"] for r in rows], [r["features"].dot(model.coefficients) + model.intercept for r in rows])


def test_fourier_machine_trains_equal_rows_as_one(spark, monkeypatch):
    def spread(cells):
        raise InterruptedError(cells.count(), cells.agg(F.sum("weight")).first()[0])

    monkeypatch.setattr(L, "spread", spread)
    for copies in (1, 7):
        with pytest.raises(InterruptedError) as found:
            L.fit_fourier(fourier_rows(spark, copies), ["a", "b"])
        assert found.value.args == pytest.approx((200, 200 * copies))


def test_fourier_machine_refuses_nulls(spark):
    with pytest.raises(Exception, match="a feature is null or NaN"):
        L.with_fourier(fourier_rows(spark).withColumn("b", F.when(F.col("a") < 0.5, F.col("b"))), ["a", "b"]).collect()


def test_split_rates_meet_vectors_not_all_splits(spark, monkeypatch):
    """Against each split by hand; a session meets its user's vector once, not a row a split."""
    import hashlib

    from padlens.operators import replicates as V
    from padlens.operators import resample as R

    monkeypatch.setattr(V, "BUCKET_ROWS", 20)
    sessions = [(i % 37, i // 3 % 2, None if i % 29 == 0 else (i * 7919 % 101) / 50) for i in range(300)]
    stats = spark.createDataFrame(sessions, "user_id long, label int, v double")
    halves = R.half_splits(stats, 6, "s")
    assert halves.count() == 37
    got = {r["split_id"]: (r["caught"], r["false_alarm"]) for r in R.split_rates(stats, halves, "v", 0.1).collect()}
    assert len(got) == 6
    for split in range(6):
        order = sorted(range(37), key=lambda u: int(hashlib.sha256(f"s|{split}|{u}".encode()).hexdigest()[:15], 16))
        fold = {u: i % 2 for i, u in enumerate(order)}
        cut = {}
        for half in (0, 1):
            genuine = sorted((float("-inf") if v is None else v for u, label, v in sessions if label == 0 and fold[u] == half), reverse=True)
            cut[half] = genuine[int(0.1 * len(genuine))]
        flags = [[v > cut[1 - fold[u]] for u, label, v in sessions if label == k and v is not None] for k in (1, 0)]
        assert got[split] == pytest.approx(tuple(sum(f) / len(f) for f in flags))


def test_rhythm_features_order_events_once(spark):
    from padlens.operators import sessions as N

    events = spark.createDataFrame(
        [(1, 1, "tap", 1000 * t, 1000 * t + 500, t) for t in (0, 2, 5, 11)] + [(2, 1, "tap", 0, 500, 20)], "user_id long, session_id long, action string, start_ms long, end_ms long, event_id long"
    )
    out = N.rhythm_features(events)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    one, two = out.orderBy("user_id").collect()
    assert [one[c] for c in ("gap10", "gap50", "gap90")] == pytest.approx([1.7, 2.5, 4.9])
    assert [two[c] for c in ("gap10", "gap50", "gap90", "entropy1", "gap_entropy", "occ_max")] == [0, 0, 0, 0, 0, 0]


def test_streaming_scores_fit_on_the_written_rows(spark, monkeypatch):
    from padlens.plans import stream_queries as S

    def balanced(train):
        raise InterruptedError(train.inputFiles())

    monkeypatch.setattr(L, "balanced", balanced)
    with pytest.raises(InterruptedError) as found:
        S.t5_streaming_scores(spark, "/root/testdata/sf0.001")
    assert found.value.args[0] and all("/stream-" in f for f in found.value.args[0])
